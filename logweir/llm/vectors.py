"""Integer vectors: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond this a sum of float64 products is not surely exact.
EXACT_FLOAT = 2**53
#: Beyond this an integer does not fit the results' type.
EXACT_LONG = 2**63


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def floors(vector: Column, scale: int) -> Column:
    """Components times `scale`, down to integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def kept_vectors(rows: DataFrame, scale: int, vector: str = "embedding") -> DataFrame:
    """vec_id, label and integer components `v` of the rows with a sound vector."""
    return rows.where(sound(F.col(vector))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "label", floors(F.col(vector), scale).alias("v")
    )


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of integers as a matrix; shorter vectors are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return np.ascontiguousarray(flat.reshape(-1, width), dtype=np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices, exactly."""
    norms = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) for m in (a, b)]
    bound = norms[0] * norms[1] * (1 + 1e-9)  # no partial sum of products can exceed it
    if bound < EXACT_FLOAT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < EXACT_LONG:
        return a @ b.T
    raise ValueError("an inner product of vectors so long does not fit 64 bits")
