"""Product codes of vectors, with codebooks refined by exponion searches.

A vector is cut into equal parts, and each part is named by the nearest entry of its
position's codebook, so a vector of 64 components becomes 16 bytes. Components are
integers, and so are entries and squared distances: every comparison is exact and
ties go to the lower index.

The nearest entry is searched from the entry that the part had in the round
before. By the triangle inequality no entry farther than twice the part's own distance from
that entry can be as near, so of the entry's neighbours, sorted by their distance from it, only those
within this radius are looked at (four times the squared distance, without a root). In
the first round the search starts at entry 0.

A round is one pass over the vectors: tasks sum their parts by entry, Spark adds the sums,
and as many rows as the codebooks have components reach the driver. No state is kept
between passes; a pass repeats the searches of the rounds before it, each started where
the last ended. So nothing as large as the input is written, and a lost task needs only its own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillmap.llm.shared import cut
from quillmap.llm.vectors import blocks, usable

#: Components beyond this in magnitude are no components: the squared distances of 256 stay within 63 bits.
MOST = 2.0**18
#: Up to so many labels their sums are broadcast; others are joined by a shuffle.
BROADCAST_LABELS = 10_000


def integers(x: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) in equal consecutive parts; vectors that can't be cut evenly end in zeros."""
    whole = np.floor(scale * x).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, -whole.shape[1] % parts))).reshape(len(whole), parts, -1)


@dataclass
class Codebooks:
    """``entries`` are (part, entry, component); for each entry all entries of its part by distance and index, and these distances."""

    entries: np.ndarray
    order: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebooks:
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(axis=-1)
        order = np.argsort(apart, axis=-1, kind="stable")
        return cls(entries, order, np.take_along_axis(apart, order, -1))

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For parts (row, part, component) the nearest entries and their squared distances, from the entries ``start``."""
        parts, size, width = self.entries.shape
        entries, order, gaps = self.entries.reshape(-1, width), (self.order + np.arange(parts)[:, None, None] * size).reshape(-1, size), self.gaps.reshape(-1, size)
        flat = x.reshape(-1, width)
        home = (start + np.arange(parts) * size).ravel()
        best = ((flat - entries[home]) ** 2).sum(axis=1)
        code, radius, inside = home.copy(), 4 * best, np.arange(len(flat))
        for k in range(size):
            inside = inside[gaps[home[inside], k] <= radius[inside]]
            if not len(inside):
                break
            other = order[home[inside], k]
            far = ((flat[inside] - entries[other]) ** 2).sum(axis=1)
            better = (far < best[inside]) | ((far == best[inside]) & (other < code[inside]))
            who = inside[better]
            best[who], code[who] = far[better], other[better]
        return code.reshape(start.shape) - np.arange(parts) * size, best.reshape(start.shape)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def searched(x: np.ndarray, books: list[Codebooks]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances under the last of the codebooks, each searched from what the one before gave."""
    code, away = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    for book in books:
        code, away = book.nearest(x, code)
    return code, away


def refined(rows: DataFrame, dims: int, books: list[Codebooks], scale: int) -> Codebooks:
    """The next codebooks: each entry the componentwise floored mean of its parts; entries without parts stay."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    parts, size, width = books[0].entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
        for _, x in blocks(batches, dims):
            x = integers(x, parts, scale)
            cell = (searched(x, held.value)[0] + np.arange(parts) * size).ravel()
            np.add.at(sums, cell, x.reshape(-1, width))
            n += np.bincount(cell, minlength=parts * size)
        used = np.flatnonzero(n)
        cells, places = np.repeat(used, width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(places, pa.int32()), pa.array(sums[used].ravel()), pa.array(np.repeat(n[used], width))], ["cell", "place", "total", "n"])

    found = rows.select("embedding").mapInArrow(run, "cell int, place int, total long, n long")
    entries = books[-1].entries.copy().reshape(-1, width)
    for r in found.groupBy("cell", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        entries[r.cell, r.place] = int(r.total) // r.n
    return Codebooks.of(entries.reshape(parts, size, width))


def fit(rows: DataFrame, dims: int, parts: int, size: int, rounds: int, scale: int) -> list[Codebooks]:
    """The codebooks before the first round and after each."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(size).select("embedding").collect()
    x = integers(np.array([r.embedding for r in first], np.float64).reshape(len(first), dims), parts, scale)
    books = [Codebooks.of(np.ascontiguousarray(x.transpose(1, 0, 2)))]
    for _ in range(rounds):
        books.append(refined(rows, dims, books, scale))
    return books


def coded(rows: DataFrame, dims: int, books: list[Codebooks], scale: int) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    parts = books[0].entries.shape[0]
    kind = ">u1" if books[0].entries.shape[1] <= 256 else ">u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches, dims):
            code, away = searched(integers(x, parts, scale), held.value)
            texts = [row.tobytes().hex() for row in code.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(away.sum(axis=1))], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the rows of ``vectors`` (vec_id, embedding, label).

    ``code`` has two hex digits for each part (eight where ``size`` is over 256). ``error``
    is the squared distance between the integer vector and its entries,
    ``label_error`` the sum of errors of the rows of a label, nulls together, and
    ``codebooks_sha256`` names the final codebooks. Codebooks start as the parts of the
    ``size`` rows of least id, of fewer where there are fewer.

    Rows whose vector is null or empty or has a null, non-finite or larger component than
    ``MOST`` are dropped, and so are rows of another length than most; a length that
    ``parts`` doesn't divide is filled up with zeros. A null id comes last among ids; rows that
    repeat an id, or all of another row, are rows of their own, those that repeat an id in order of
    their vectors. An empty table gives an empty table; other columns are ignored.
    """
    rows, dims = usable(vectors, MOST, "label")
    if not dims:
        none = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    books = fit(rows, dims, parts, size, rounds, scale)
    found = cut(coded(rows, dims, books, scale))
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("long")
    sums = cut(found.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"))
    few = sums.count() <= BROADCAST_LABELS
    both = found.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "label", "code", "error", "label_error", F.lit(books[-1].sha256()).alias("codebooks_sha256"))
