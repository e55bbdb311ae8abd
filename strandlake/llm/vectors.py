"""Embedding tables: which vectors count, and equal vectors as one class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(table: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>, h1, h2) of usable vectors of the commonest length; h1 and h2 name the vector."""
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("embedding") == (common["d"] if common else 0))
    return rows.select("vec_id", "embedding", F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of an array<double> column (all of one length) as a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.float64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two (which is exact) that bring their largest component near 1, so that squares neither overflow nor vanish."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of x[i] and y[i]: worked out in the widest floats at hand, then rounded once to double precision.

    So the order of sums doesn't show, and two pairs are equal only if their cosines are the same double.
    """
    x, y = _scaled(x).astype(np.longdouble), _scaled(y).astype(np.longdouble)
    lengths = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
    return (np.einsum("ij,ij->i", x, y) / lengths).astype(np.float64)
