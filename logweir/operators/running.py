"""Ordered running totals that no single key can overload.

A plain window over a key sorts all its rows in one task. Here the rows of a key
are cut into ordered slices: each slice is summed on its own, the slice totals
are summed in front, and both are added. Every task holds one slice at most, and
only one small row per slice meets in the key's own window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    rows: DataFrame,
    keys: list[str],
    slice_column: str,
    order: list[str],
    measures: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums of `measures` per `keys`, ordered by `order`.

    `slice_column` must not decrease along `order` and must not be NULL. The
    order has to be total, so merge equal rows first.
    """
    slices = [*keys, slice_column]
    inside = Window.partitionBy(*slices).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = rows.select("*", *[F.sum(m).over(inside).alias(f"_in_{n}") for n, m in measures.items()])

    front = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*slices).agg(*[F.sum(m).alias(f"_sum_{n}") for n, m in measures.items()])
    offsets = totals.select(
        *slices,
        *[F.coalesce(F.sum(f"_sum_{n}").over(front), F.lit(0)).alias(f"_before_{n}") for n in measures],
    )
    return local.join(offsets, slices).select(
        *rows.columns, *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in measures]
    )
