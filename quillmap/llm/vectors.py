"""Rows of vectors as numpy arrays, for the operators that read vectors in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Vectors worked on in one go.
ROWS = 1024


def finite(embedding: str, most: float) -> Column:
    """Whether a vector is not null or empty and has no component that is null, not finite or beyond ``most``."""
    return F.expr(f"coalesce(size(`{embedding}`) > 0 and forall(`{embedding}`, x -> x is not null and not isnan(x) and abs(x) <= {most!r}D), false)")


def usable(vectors: DataFrame, most: float, *columns: str) -> tuple[DataFrame, int]:
    """The finite rows (vec_id, columns, embedding) of the commonest length, the least of equally
    common ones, and that length; 0 where no row is left."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *columns, F.col("embedding").cast("array<double>").alias("embedding")).where(finite("embedding", most))
    lengths = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").head(1)
    dims = lengths[0].dims if lengths else 0
    return rows.where(F.size("embedding") == dims), dims


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of some rows and their vectors."""
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            part = batch.slice(k, ROWS)
            yield part, part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
