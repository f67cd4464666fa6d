"""Duplicates, poison rate and reconciliation between tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_id() -> Column:
    """Whether an event has an id, of whatever type."""
    return F.coalesce(F.col("event_id").cast("string"), F.lit("")) != ""


def dedup_events(events: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row per event id: the earliest, or the first in the given order; ties are
    broken by all columns. Events without an id are different events: all are kept.

    The rank limit is applied before the shuffle too, so many copies of one event
    shrink to one per task.
    """
    named = has_id()
    ties = [F.col(c) for c, kind in events.dtypes if c != "event_id" and not kind.startswith(("map", "variant"))]
    ranked = Window.partitionBy("event_id").orderBy(*(order or [F.asc("timestamp")]), *ties)
    first = events.filter(named).withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")
    return first.unionByName(events.filter(~named))


def duplicate_count(events: DataFrame) -> DataFrame:
    """Rows, distinct ids and surplus copies; copies are merged before the shuffle."""
    ids = events.groupBy("event_id").agg(F.count("*").alias("n"))
    return ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_ids")
    ).withColumn("duplicates", F.col("rows") - F.col("distinct_ids"))


def approximate_duplicates(events: DataFrame, error: float = 0.01) -> DataFrame:
    """Same measure from a sketch, for tables too large to group by id."""
    return events.agg(
        F.count("*").alias("rows"), F.approx_count_distinct("event_id", error).alias("distinct_ids")
    ).withColumn("duplicates", F.greatest(F.col("rows") - F.col("distinct_ids"), F.lit(0)))


def poison_rate(decoded: DataFrame) -> DataFrame:
    """Dead-lettered events relative to processed ones."""
    counts = decoded.agg(
        F.count_if(F.col("decode_error").isNull()).alias("processed"),
        F.count_if(F.col("decode_error").isNotNull()).alias("dead_lettered"),
    )
    ratio = F.col("dead_lettered") / F.col("processed")
    return counts.withColumn("poison_rate", F.when(F.col("processed") > 0, ratio))


def presence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Copies of every event id in two tiers: one grouping instead of a join, so
    repeated ids are merged before they travel."""
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    marked = left.select("event_id", one.alias("left_rows"), zero.alias("right_rows")).unionByName(
        right.select("event_id", zero.alias("left_rows"), one.alias("right_rows"))
    )
    return marked.groupBy("event_id").agg(
        F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows")
    )


def reconcile(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Distinct events and rows that are in both tiers or in one only."""
    status = (
        F.when(F.col("right_rows") == 0, "hot_only")
        .when(F.col("left_rows") == 0, "cold_only")
        .otherwise("both")
    )
    return presence(hot, cold).groupBy(status.alias("status")).agg(
        F.count("*").alias("events"),
        F.sum("left_rows").alias("hot_rows"),
        F.sum("right_rows").alias("cold_rows"),
    )


def cross_check(accepted: DataFrame, processed: DataFrame, dead: DataFrame, archived: DataFrame) -> DataFrame:
    """Events of each day and service by fate: what was accepted has to be archived, and
    to be processed or dead-lettered. Every input needs `day` and `service` per event."""
    given = {"accepted": accepted, "processed": processed, "dead_lettered": dead, "archived": archived}
    marked = None
    for fate, rows in given.items():
        own = _marked(rows, fate)
        marked = own if marked is None else marked.unionByName(own)
    return _balance(marked)


def cross_check_lines(lines: DataFrame, archived: DataFrame) -> DataFrame:
    """cross_check() of lines that were judged in one pass (`sources.archive.judged`).

    They are counted before they are told apart by fate, so no line is parsed for each fate.
    """
    dead = F.col("decode_error").isNotNull()
    counted = lines.groupBy("day", "service", "event_day", "event_service", dead.alias("dead")).agg(F.count("*").alias("n"))
    here = [F.col("day").alias("day"), F.col("service").alias("service")]
    decoded = [F.col("event_day").alias("day"), F.col("event_service").alias("service")]
    fate = lambda name, place: F.struct(F.lit(name).alias("fate"), *place)
    own = F.when(F.col("dead"), fate("dead_lettered", here)).otherwise(fate("processed", decoded))
    marked = counted.select("n", F.inline(F.array(fate("accepted", here), own)))
    return _balance(marked.unionByName(_marked(archived, "archived")))


FATES = ("accepted", "processed", "dead_lettered", "archived")


def _marked(rows: DataFrame, fate: str) -> DataFrame:
    return rows.select("day", "service", F.lit(fate).alias("fate"), F.lit(1).cast("bigint").alias("n"))


def _balance(marked: DataFrame) -> DataFrame:
    counts = marked.groupBy("day", "service").agg(
        *[F.sum(F.when(F.col("fate") == f, F.col("n")).otherwise(0)).alias(f) for f in FATES]
    )
    complete = (F.col("accepted") == F.col("archived")) & (
        F.col("accepted") == F.col("processed") + F.col("dead_lettered")
    )
    return counts.withColumn("balanced", complete)


def missing_events(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Ids of `expected` that `found` lacks."""
    return presence(expected, found).filter(
        (F.col("left_rows") > 0) & (F.col("right_rows") == 0)
    ).select("event_id")
