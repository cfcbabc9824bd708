"""Whitening of vectors by a tall-skinny QR decomposition.

Components become integers, so their sums are exact, and rows are centred with
them before anything is multiplied. Each task reduces its centred rows to one
triangular factor, block by block; the factors are merged in a tree of three
shuffles, so no task meets more than a share of them, and the last one, as wide and high
as a vector is long, reaches the driver. Its singular values and right vectors are those of all
centred rows: squared and divided by the number of rows the values are the eigenvalues
of the covariance, and the vectors whiten. The covariance itself, whose condition is the
square of the rows', is never formed.

A last pass checks the result: it sums the products of whitened components over all rows
and tells how far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillmap.llm.vectors import blocks, usable

#: Components beyond this in magnitude are no components: the sums of 2**26 rows stay within 63 bits.
MOST = 2.0**30
SCALE, SHIFT = 64, 1_000_000
#: Factors that are left after each level of the tree.
LEVELS = (1024, 32, 1)


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


@dataclass
class Mean:
    """The exact mean of each dimension as whole + rest / n, 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)**2 of each row, exact; None where 63 bits don't hold it."""
        near = x - self.whole
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if x.shape[1] * most * most < 1 << 63:
            return ((self.n * near - self.rest) ** 2).sum(axis=1).tolist()
        found = ((self.n * near.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in found]


def mean(rows: DataFrame, dims: int) -> Mean:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for _, x in blocks(batches, dims):
            total += integers(x).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(total), pa.array(np.full(dims, n))], ["dim", "total", "n"])

    parts = rows.select("embedding").mapInArrow(run, "dim int, total long, n long")
    got = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()
    n = got[0].n
    both = [divmod(int(r.total), n) for r in got]
    return Mean(n, np.array([b[0] for b in both], np.int64), np.array([b[1] for b in both], np.int64))


def triangle(above: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """The triangular factor of some rows below another factor."""
    return np.linalg.qr(x if above is None else np.vstack((above, x)), mode="r")


def factor(rows: DataFrame, dims: int, centre: Mean) -> np.ndarray:
    """The triangular factor of all centred rows."""
    held = rows.sparkSession.sparkContext.broadcast(centre)
    kinds = pa.schema([("place", pa.int64()), ("r", pa.binary())])

    def of(place: int, r: np.ndarray | None) -> pa.Table:
        return pa.table([pa.array([] if r is None else [place], pa.int64()), pa.array([] if r is None else [np.ascontiguousarray(r).tobytes()], pa.binary())], schema=kinds)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in blocks(batches, dims):
            r = triangle(r, held.value.centred(integers(x)))
        yield from of(TaskContext.get().partitionId(), r).to_batches()

    def merge(batch: pa.Table) -> pa.Table:
        batch, r = batch.sort_by("place"), None
        for raw in batch.column("r"):
            r = triangle(r, np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, dims))
        return of(batch.column("place")[0].as_py(), r)

    parts = rows.select("embedding").mapInArrow(reduce, "place long, r binary")
    for left in LEVELS:
        parts = parts.withColumn("group", F.col("place") % left).groupBy("group").applyInArrow(merge, "place long, r binary")
    (last,) = parts.collect()
    return np.frombuffer(bytes(last.r), np.float64).reshape(-1, dims)


@dataclass
class Whitening:
    """What a pass needs: the mean, the scaled right vectors (dims, components), the shares of variance, and which components have any."""

    centre: Mean
    basis: np.ndarray
    explained: np.ndarray
    spread: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.basis


def fit(rows: DataFrame, dims: int, components: int) -> Whitening:
    centre = mean(rows, dims)
    r = factor(rows, dims, centre)
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    s = np.pad(s, (0, dims - len(s)))[:dims]
    k = min(components, dims)
    spread = s[:k] > s[0] * max(dims, len(r)) * np.finfo(float).eps
    v = vt[:k].T
    # either sign would do; the largest entry is positive
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    scale = np.where(spread, np.sqrt(centre.n) / np.where(spread, s[:k], 1.0), 0.0)
    total = float((s * s).sum())
    return Whitening(centre, np.ascontiguousarray(v * scale), s[:k] ** 2 / total if total > 0 else np.zeros(k), spread)


def identity_error(rows: DataFrame, dims: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened components' covariance less the identity, of
    components that have variance; 0 without any."""
    held, k = rows.sparkSession.sparkContext.broadcast(model), int(model.spread.sum())
    if not k:
        return 0.0
    a, b = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for _, x in blocks(batches, dims):
            z = held.value.whitened(integers(x))[:, held.value.spread]
            products += z.T @ z
            sums += z.sum(axis=0)
        values = np.concatenate((products[a, b], sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    parts = rows.select("embedding").mapInArrow(run, "at int, value double")
    found = np.zeros(len(a) + k)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        found[r["at"]] = r["value"] / model.centre.n
    middle = found[len(a) :]
    return float(np.abs(found[: len(a)] - middle[a] * middle[b] - (a == b)).max())


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row of
    ``vectors`` (vec_id, embedding) and component, from 1 by falling variance.

    ``n`` rows are fitted, all that are left; ``deviation`` is the exact sum over
    dimensions of (n * x - S)**2 over the integers x and their sums S, null where 63 bits
    don't hold it. ``whitened`` is the centred row on the component, over the root of the component's variance,
    and 0 for a component without variance; ``explained`` is the variance's share of all, 0 where there is none. Of
    equal variances any rotation may come out, the same for all rows.

    Rows whose vector is null or empty or has a null, non-finite or larger entry than
    ``MOST`` are dropped, and so are rows of another length than most. Rows that repeat an
    id or all of another row count and come out one by one, null ids too. A vector
    shorter than ``components`` has as many components as entries. An empty table gives an
    empty table; other columns are ignored.
    """
    rows, dims = usable(vectors, MOST)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return rows.sparkSession.createDataFrame([], kinds)
    model = fit(rows, dims, components)
    error = identity_error(rows, dims, model)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = m.basis.shape[1]
        for batch, x in blocks(batches, dims):
            x = integers(x)
            who = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(m.centre.deviations(x), pa.int64())
            columns = [batch.column("vec_id").take(pa.array(who)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(who), m.centre.n), deviation.take(pa.array(who))]
            columns += [m.whitened(x).ravel(), np.tile(m.explained, len(x)), np.full(len(who), error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in kinds.split(", ")])

    return rows.mapInArrow(run, kinds)
