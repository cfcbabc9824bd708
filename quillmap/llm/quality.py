"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes the damped, idf-weighted, length-normalised counts of its hashed
byte trigrams, joined by a few shares that a bag of trigrams can't show (words
that repeat the word before, capitals, symbols). A truncated SVD of a bounded
sample of labelled rows gives the latent space. The labelled vectors of the sample are broadcast (at most
``sample_rows`` rows of ``rank`` floats, about 1 MB); every document is compared
with all of them in blocks of exact cosine products, and its nearest neighbours
vote with their similarity.

The sample bound is a parameter of the fit alone. Every document is scored,
from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmap.llm.text import encode, gram_counts

BITS = 12
#: Documents per block of cosine products.
BLOCK = 256
#: Cosines that differ by no more are equal: copies differ by rounding.
TIE = 1e-6


#: Weight of the shares beside the trigrams, which have length 1 together.
SHARE, SHARES = 1.5, 3

_CAPITAL = bytes(range(65, 91))
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,")


def counts(text: str | None) -> np.ndarray:
    """Trigram counts, then the shares in millionths."""
    raw = encode(text)
    words = raw.split()
    repeats = sum(map(eq, words, words[1:])) / max(len(words) - 1, 1)
    shares = [repeats] + [(len(raw) - len(raw.translate(None, c))) / max(len(raw), 1) for c in (_CAPITAL, _SYMBOL)]
    return np.concatenate((gram_counts(b" " + raw + b" ", 3, BITS), np.array([int(1e6 * x) for x in shares])))


@dataclass
class Model:
    """What the executors need: idf and projection, labelled vectors, votes."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float
    prior: float

    def embed(self, rows: np.ndarray) -> np.ndarray:
        x = _raw_terms(rows)
        _weigh(x, self.idf)
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        close = self.embed(rows) @ self.vectors.T
        k = min(self.neighbours, close.shape[1])
        # neighbours as near as the kth vote too, so ties have a defined result
        least = np.partition(close, close.shape[1] - k, axis=1)[:, close.shape[1] - k]
        who, what = np.nonzero(close >= least[:, None] - TIE)
        weight = np.maximum(close[who, what], 0.0).astype(np.float64) ** self.power
        total = np.bincount(who, weight, len(rows))
        vote = np.bincount(who, weight * self.labels[what], len(rows))
        return np.where(total > 0, vote / np.where(total > 0, total, 1.0), self.prior)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, rank: int = 64, neighbours: int = 11, power: float = 8.0) -> Model:
    """Learn from ``labels`` (doc_id, quality 0/1), joined to ``docs`` on doc_id.

    At most ``sample_rows`` labelled ids are used, those with the smallest
    hash, of either label half if there are as many: the hot label
    can't crowd out the other. An id has one place for each of its labels, however many rows
    repeat it; of different texts of an id the least counts. Labels that are null or neither 0 nor 1 are
    ignored; contradicting labels of an id all vote. Without usable labels the
    model scores 0.5 throughout.
    """
    rows = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality")]
    picked = [(r.doc_id, r.quality) for q in (0, 1) for r in rows.where(F.col("quality") == q).orderBy(*order).limit(sample_rows // 2).collect()]
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame(picked, "doc_id long, quality int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # half precision is plenty for the sample, and halves what the driver holds
            found = [_raw_terms(counts(x)[None])[0].astype(np.float16).tobytes() for x in pdf["text"]]
            yield pd.DataFrame({"quality": pdf["quality"], "doc_id": pdf["doc_id"], "grams": found})

    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, "doc_id")
    # one text for each place, before anything is counted: the ids are few, their rows may be many
    one = joined.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = one.mapInPandas(run, "quality int, doc_id long, grams binary").toPandas()
    if got.empty:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(((1 << BITS) + SHARES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power, 0.5)
    got = got.sort_values(["doc_id", "quality", "grams"], ignore_index=True)
    y, z = got["quality"].to_numpy(np.float64), np.empty((len(got), (1 << BITS) + SHARES), np.float32)
    for i, grams in enumerate(got.pop("grams")):
        z[i] = np.frombuffer(grams, np.float16)
    idf = (np.log((1 + len(z)) / (1 + np.count_nonzero(z[:, : 1 << BITS], axis=0))) + 1).astype(np.float32)
    _weigh(z, idf)
    basis = _top_right(z, min(rank, *z.shape))
    vectors = z @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(idf, basis, vectors, y, neighbours, power, 0.5)


def _raw_terms(rows: np.ndarray) -> np.ndarray:
    """Damped counts, and the weighted shares."""
    x = rows.astype(np.float32)
    np.log1p(x[:, : 1 << BITS], out=x[:, : 1 << BITS])
    x[:, 1 << BITS :] = np.float32(SHARE) * np.sqrt(x[:, 1 << BITS :] / 1e6)
    return x


def _weigh(x: np.ndarray, idf: np.ndarray) -> None:
    """idf and length 1 for the trigrams, in place."""
    grams = x[:, : 1 << BITS]
    grams *= idf
    for k in range(0, len(x), BLOCK):
        part = grams[k : k + BLOCK]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)


def _top_right(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by randomised subspace iteration."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt.T)[:, :rank])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``quality_score`` (0 to 1), one row per row.

    Null text counts as empty; empty texts are scored like any other, and so are
    repeated rows, one by one. Neighbours as near as the last that votes vote too. An
    empty table gives an empty table; other columns go through unchanged, but for a
    ``quality_score``, which is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop("quality_score").withColumn("quality_score", F.lit(0.0)).schema

    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column("text")
            out = [m.score(np.stack([counts(x.as_py()) for x in texts[k : k + BLOCK]])) for k in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *out]))], names)

    return docs.drop("quality_score").mapInArrow(run, schema)
