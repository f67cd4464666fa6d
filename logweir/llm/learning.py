"""Labelled rows for the classifiers, and their last step: a weighted logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; NULL ids count as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, label of at most `per_class` labelled rows of either class, by hash order of their id.

    The bound makes the classifier's training a fixed amount of work at any table size;
    rows within it don't depend on partitions or on the order of files.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("label")
    )
    own = own.where(fold(F.col("l_id"), 4) != 2).groupBy("l_id").agg(F.max("label").alias("label"))
    by_hash = [F.xxhash64("l_id"), F.col("l_id")]
    parts = [own.where(F.col("label") == c).orderBy(*by_hash).limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * per_class ids at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(chosen, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "label")


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Labelled rows outside the held-out fold, of class 0 and 1."""
    rows = labels.where(fold(F.col("doc_id"), 4) != 2).groupBy(label).count().where(F.col(label).isin(0, 1)).collect()
    found = {int(r[0]): int(r[1]) for r in rows}
    return found.get(0, 0), found.get(1, 0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    weight = weight / max(weight.sum(), 1e-9)
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def apply_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(w[0] + x @ w[1:])
