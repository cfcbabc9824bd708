"""Conflict-constrained best-fit packing of documents into token bins.

Documents are dealt by a hash of id and text into shards of about
``shard_rows`` rows, whatever their source or cluster, and every shard is
packed on its own, in decreasing order of length. The open bins of a shard
stand in order of their residual room; each carries a bitmap of the sources
and one of the duplicate clusters in it. For a piece the search starts at the
first bin with room enough (the successor of the piece's length) and goes on
through roomier bins until the first without a conflict, which is the tightest
compatible one; only if there is none a bin is opened.

A document longer than a bin is cut into full pieces, each a bin of its own,
and a rest. Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillmap.llm.shared import cut
from quillmap.llm.text import lower_words

#: Bins looked at in one step of the successor search.
STEP = 512


class Bins:
    """Open bins of one shard, ordered by residual room."""

    def __init__(self, capacity: int, most: int, sources: int, clusters: int):
        self.capacity, self.open = capacity, 0
        self.room, self.at = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.used = np.zeros(most, np.int64)
        self.sources = np.zeros((most, sources // 64 + 1), np.uint64)
        self.clusters = np.zeros((most, clusters // 64 + 1), np.uint64)
        self.made = 0

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; source or cluster is -1 where it can't conflict."""
        first = int(np.searchsorted(self.room[: self.open], length, "left"))
        for lo in range(first, self.open, STEP):
            ids = self.at[lo : min(lo + STEP, self.open)]
            free = np.ones(len(ids), bool)
            for bits, x in ((self.sources, source), (self.clusters, cluster)):
                if x >= 0:
                    free &= (bits[ids, x >> 6] >> np.uint64(x & 63)) & np.uint64(1) == 0
            hit = int(free.argmax())
            if free[hit]:
                return self._fill(lo + hit, length, source, cluster)
        self._insert(self.capacity, self.made)
        self.made += 1
        return self._fill(int(np.flatnonzero(self.at[: self.open] == self.made - 1)[0]), length, source, cluster)

    def _fill(self, k: int, length: int, source: int, cluster: int) -> tuple[int, int]:
        b, room = int(self.at[k]), int(self.room[k])
        self.room[k : self.open - 1] = self.room[k + 1 : self.open].copy()
        self.at[k : self.open - 1] = self.at[k + 1 : self.open].copy()
        self.open -= 1
        for bits, x in ((self.sources, source), (self.clusters, cluster)):
            if x >= 0:
                bits[b, x >> 6] |= np.uint64(1 << (x & 63))
        offset = int(self.used[b])
        self.used[b] += length
        self._insert(room - length, b)
        return b, offset

    def _insert(self, room: int, b: int) -> None:
        k = int(np.searchsorted(self.room[: self.open], room, "right"))
        self.room[k + 1 : self.open + 1] = self.room[k : self.open].copy()
        self.at[k + 1 : self.open + 1] = self.at[k : self.open].copy()
        self.room[k], self.at[k] = room, b
        self.open += 1


def pack_shard(pdf: pd.DataFrame, capacity: int, source_conflict: bool) -> pd.DataFrame:
    """Pieces of the rows of one shard: doc_id, piece, bin, start, n_tokens."""
    length = pdf["n_tokens"].to_numpy(np.int64)
    rest = np.where(length > 0, (length - 1) % capacity + 1, 0)
    whole = (length - rest) // capacity
    source = pd.factorize(pdf["source"])[0] if source_conflict else np.full(len(pdf), -1)
    code = pd.factorize(pdf["cluster"])[0]
    shared = np.flatnonzero(np.bincount(code) > 1) if len(code) else code
    cluster = np.full(len(code), -1)
    at = np.searchsorted(shared, code)
    inside = (at < len(shared)) & (length > 0)
    cluster[inside] = np.where(shared[at[inside]] == code[inside], at[inside], -1)
    bins = Bins(capacity, len(pdf) + 1, int(source.max(initial=-1)) + 1, len(shared))
    out = []
    ids = pdf["doc_id"].tolist()
    for i in np.lexsort((pdf["hash"].to_numpy(np.int64), -rest)).tolist():
        b, offset = bins.place(int(rest[i]), int(source[i]), int(cluster[i]))
        out.append((ids[i], int(whole[i]), b, offset, int(rest[i])))
    full = bins.made
    for i in np.flatnonzero(whole).tolist():
        for piece in range(int(whole[i])):
            out.append((ids[i], piece, full, 0, capacity))
            full += 1
    return pd.DataFrame(out, columns=["doc_id", "piece", "bin", "start", "n_tokens"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, cluster, hash): words of the whole text, a hash
    of its lowered words that is equal for copies, and a hash of the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, cluster = [], []
            for text in pdf["text"]:
                words = lower_words(text)
                n.append(len(words))
                cluster.append(xxhash.xxh64_intdigest(b" ".join(words), 0) - (1 << 63))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": n, "cluster": cluster})

    # ids go as text: pandas would make a column of longs with nulls one of doubles
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInPandas(run, "doc_id string, source string, n_tokens long, cluster long")
    return rows.withColumn("hash", F.xxhash64("doc_id", "cluster", "source"))


def pack(docs: DataFrame, capacity: int = 2048, shard_rows: int = 20000, source_conflict: bool = True) -> DataFrame:
    """(doc_id, piece, bin_id, start, n_tokens): where each piece of each row goes.

    No bin holds more than ``capacity`` tokens, two pieces of one duplicate
    cluster, or (with ``source_conflict``) two documents of one source; a null
    source conflicts with nothing. Pieces of a document are numbered from 0 and
    the rest comes last. Null and empty texts are pieces of length 0. Rows
    that repeat an id are packed one by one and can't share a bin when their
    texts are equal. An empty table gives an empty table; extra columns are
    ignored. Ids of bins are unique, not consecutive.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = cut(measured(docs))
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod("hash", F.lit(shards)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = pack_shard(pdf, capacity, source_conflict)
        found["bin_id"] = found.pop("bin") + (int(key[0]) << 32)
        return found[["doc_id", "piece", "bin_id", "start", "n_tokens"]]

    found = rows.groupBy("shard").applyInPandas(run, "doc_id string, piece long, bin_id long, start long, n_tokens long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
