"""SimHash near-duplicates by multi-index hashing.

The fingerprint of a text is the bitwise majority of the XXH64 hashes of its
word shingles. Two fingerprints within ``distance`` bits agree, by the
pigeonhole principle, up to ``distance // segments`` bits in at least one of
``segments`` equal segments. With 64 bits, two segments and distance 3 a small
ball of radius 1 around each 32-bit half has to be looked up. A probe flips a
bit only where it is zero: of two halves one bit apart, exactly one has the
zero, so each such pair meets once. Looked-up pairs are verified inside the
join on all 64 bits, so only links leave it.

Equal fingerprints are collapsed first, so copies cost one probe set however
many there are. The tables that meet hold one row per distinct fingerprint and
segment, keyed by 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quillmap.llm.components import components
from quillmap.llm.shared import cut
from quillmap.llm.text import lower_words

#: Shingles hashed at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint; zero if the text has no word."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, BLOCK):
        part = zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())
        hashes = np.array([digest(joined[i:j], seed) for i, j in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row, from its whole text; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(x.as_py(), width, seed) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(prints: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``distance`` bits.

    ``prints`` has one row per fingerprint in column fp. Pairs may repeat.
    """
    if 64 % segments or distance // segments > 1:
        raise ValueError("segments must divide 64 and leave a radius of at most 1")
    bits, radius = 64 // segments, distance // segments
    mask = (1 << bits) - 1
    halves = F.array(*[
        F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", s * bits).bitwiseAND(F.lit(mask)).alias("key"))
        for s in range(segments)
    ])
    stored = prints.select("fp", F.inline(halves))
    flips = [0] + [1 << i for i in range(bits)] * radius
    probes = stored.select(F.col("fp").alias("qfp"), "seg", "key", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip"))
    probes = probes.where(F.col("key").bitwiseAND(F.col("flip")) == 0).select("qfp", "seg", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "flip")
    near = F.bit_count(F.col("qfp").bitwiseXOR(F.col("fp"))) <= distance
    once = (F.col("flip") != 0) | (F.col("qfp") < F.col("fp"))
    p, t = probes.alias("p"), stored.alias("t")
    found = p.join(t, (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & near & once)
    return found.select(F.least("qfp", "fp").alias("a"), F.greatest("qfp", "fp").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id) per row of ``docs``.

    Ids that repeat give a row each. Null text counts as empty: fingerprint
    zero, linked like any other. A row with a null id takes part, but can't
    be the smallest id; a group of such rows alone has a null component. Other
    columns are ignored. An empty table gives an empty table.
    """
    prints = cut(fingerprints(docs, width, seed))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(links(distinct, distance))
    grouped = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    grouped = cut(grouped)
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(column: str) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
