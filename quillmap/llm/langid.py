"""Language identification: averaged hashed subword embeddings, linear softmax.

Letters of a text are lowered, everything else becomes a space, and the byte
3-grams and 4-grams of the result (so also those at the edge of a word) are
hashed into buckets. A text is the mean of its buckets' embeddings; a linear
softmax on it names the language. Both layers are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows. A temperature
fitted on a fold of the sample that the descent has not seen calibrates the
confidence, and a prediction under one half, likelier wrong than right, is
rejected.

For prediction the two linear layers are folded into one table of buckets by
languages, 2**BITS rows, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillmap.llm.text import encode, gram_bins

BITS = 15
UNKNOWN = "und"

_SPACES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    """Lowered letters; ASCII others are spaces, runs of which are one."""
    return b" ".join(encode(text.lower() if text else text).translate(_SPACES).split()).join((b" ", b" "))


def buckets(text: str | None) -> Iterator[np.ndarray]:
    raw = letters(text)
    for n in (3, 4):
        yield from gram_bins(raw, n, BITS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    floor: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated confidence, and whether it is rejected."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        total, n = np.zeros(len(self.languages)), 0
        for codes in buckets(text):
            total += self.table[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        p = _softmax((total / max(n, 1) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.floor)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits, scaled where a long text has larger ones."""
    return np.maximum(counts * min(1.0, 65535 / max(int(counts.max(initial=0)), 1)), 1).astype(np.uint16)


def _parts(shares: np.ndarray) -> np.ndarray:
    return (shares / max(int(shares.sum(dtype=np.int64)), 1)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: DataFrame, sample_rows: int = 4000, dims: int = 16, epochs: int = 6, rate: float = 0.5, floor: float = 0.5) -> Model:
    """Learn from ``rows`` (doc_id, text, lang).

    At most ``sample_rows`` rows are used: those with the smallest hash of
    their id and text, dealt evenly over the languages, so a hot language can't crowd
    out the others. Rows without a language or without a letter are ignored;
    repeated rows count as often as the sample has them.
    Without usable rows every prediction is ``und``.
    """
    empty = Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, floor)
    usable = rows.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = usable.groupBy("lang").agg(F.count("*").alias("rows")).collect()
    if not found:
        return empty
    quota = max(sample_rows // len(found), 1)
    # about twice the quota of each language go on, so no task meets more than a few thousand rows of one
    parts = F.broadcast(rows.sparkSession.createDataFrame([(r.lang, min(1.0, 2.0 * quota / r.rows)) for r in found], "lang string, part double"))
    few = usable.join(parts, "lang").withColumn("hash", F.xxhash64("doc_id", "text")).where(F.shiftrightunsigned("hash", 11).cast("double") * F.lit(2.0**-53) < F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, lang, text in zip(*(batch.column(c) for c in ("hash", "lang", "text"))):
                text = text.as_py()
                if has_letter(text):
                    n = sum(np.bincount(c, minlength=1 << BITS) for c in buckets(text))
                    at = np.flatnonzero(n)
                    out.append((h.as_py(), lang.as_py(), at.astype(np.uint16).tobytes(), _shares(n[at]).tobytes()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["hash", "lang", "at", "part"]), schema, preserve_index=False)

    schema = pa.schema([("hash", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("part", pa.binary())])
    seen = few.select("hash", "lang", "text").mapInArrow(run, "hash long, lang string, at binary, part binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "at"))
    got = seen.withColumn("place", place).where(F.col("place") <= quota).collect()
    got = sorted((r.hash, r.lang, bytes(r.at), bytes(r.part)) for r in got)
    if not got:
        return empty
    names = sorted({g[1] for g in got})
    x = [(np.frombuffer(g[2], np.uint16).astype(np.int32), _parts(np.frombuffer(g[3], np.uint16))) for g in got]
    y = np.array([names.index(g[1]) for g in got])
    rng = np.random.default_rng(11)
    fold = rng.permutation(len(x))
    kept, aside = (fold[len(x) // 5 :], fold[: len(x) // 5]) if len(x) >= 10 else (fold, fold)
    embed = rng.uniform(-1, 1, (1 << BITS, dims)).astype(np.float32) / dims
    out, bias = np.zeros((len(names), dims), np.float32), np.zeros(len(names), np.float32)
    steps, done = epochs * len(kept), 0
    for _ in range(epochs):
        for i in rng.permutation(kept):
            at, part = x[i]
            lr, done = rate * (1 - done / steps), done + 1
            rows_at = embed[at]
            hidden = part @ rows_at
            wrong = _softmax(out @ hidden + bias)
            wrong[y[i]] -= 1
            back = wrong @ out
            out -= lr * np.outer(wrong, hidden)
            bias -= lr * 0.1 * wrong
            # the mean is over the text, so its parts carry the gradient; the factor makes up for their smallness
            embed[at] = rows_at - lr * 10 * np.outer(part, back).astype(np.float32)
    folded = (embed @ out.T).astype(np.float32)
    logits = np.array([part @ folded[at] + bias for at, part in (x[i] for i in aside)])
    return Model(names, folded, bias.astype(np.float64), _temperature(logits, y[aside]), floor)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least cross-entropy on the set-aside fold."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = []
    for t in grid:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss.append((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())
    return float(grid[int(np.argmin(loss))])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected, row by row.

    Null texts and texts without a letter are ``und``, score 0, rejected. Of equal
    confidences the first language by name wins. Repeated rows are predicted one by
    one, an empty table gives an empty table, other columns go through unchanged
    but for those named like the added ones, which are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    clean = docs.drop("lang_pred", "lang_score", "lang_rejected")
    schema = clean.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_rejected": F.lit(False)}).schema

    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            got = [m.predict(x.as_py()) for x in batch.column("text")]
            new = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    return clean.mapInArrow(run, schema)

