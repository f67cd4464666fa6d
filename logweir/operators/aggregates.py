"""Timelines, counts and rollups of log events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.text import SEVERITY_ORDER, fingerprint, is_error, message_template
from logweir.functions.times import window_start
from logweir.operators.search import in_range

COARSE_AFTER_HOURS = 168


def bucket_span(hours: int) -> timedelta:
    """Five-minute buckets, hourly ones for ranges longer than a week."""
    return timedelta(seconds=3600 if hours > COARSE_AFTER_HOURS else 300)


def timeline(
    logs: DataFrame, as_of: datetime, hours: int = 24, service: str = "", span: timedelta | None = None
) -> DataFrame:
    """Events and ERROR events per time bucket; empty buckets are absent."""
    rows = logs.filter(in_range(as_of - timedelta(hours=hours), as_of))
    if service:
        rows = rows.filter(F.col("service") == service)
    bucket = window_start(F.col("timestamp"), span or bucket_span(hours))
    return (
        rows.groupBy(bucket.alias("bucket"))
        .agg(
            F.count("*").alias("count"),
            F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        )
        .orderBy("bucket")
    )


def scale_timeline(buckets: DataFrame) -> DataFrame:
    """Counts relative to the largest bucket, for drawing."""
    peak = F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    return buckets.select(
        "bucket",
        "count",
        "error_count",
        (F.col("count") / peak).alias("count_share"),
        (F.col("error_count") / peak).alias("error_share"),
    )


def service_severity_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("service", "severity").agg(F.count("*").alias("count"))


def nested_counts(counts: DataFrame) -> DataFrame:
    """One row per service with a map of its severities, in their order."""
    pairs = F.array_sort(F.collect_list(F.struct("severity", "count")))
    return counts.groupBy("service").agg(F.map_from_entries(pairs).alias("severities"))


def _percent(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(F.lit(0.0))


def _errors():
    return F.coalesce(F.sum(F.when(is_error(F.col("severity")), F.col("count"))), F.lit(0))


def summary(counts: DataFrame) -> DataFrame:
    """Totals over all services, from service and severity counts."""
    totals = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        _errors().alias("errors"),
        F.count_distinct("service").alias("services"),
    )
    return totals.withColumn("error_rate", _percent("errors", "total"))


def service_breakdown(counts: DataFrame) -> DataFrame:
    """Totals per service, largest first, with the share of the largest."""
    services = counts.groupBy("service").agg(F.sum("count").alias("total"), _errors().alias("errors"))
    return (
        services.withColumn("error_rate", _percent("errors", "total"))
        .withColumn("width", F.col("total") / F.max("total").over(Window.partitionBy()) * 100)
        .orderBy(F.desc("total"), "service")
    )


def severity_distribution(counts: DataFrame) -> DataFrame:
    """Known severities that occur, gravest first, as share of all events."""
    # Six groups at most: unknown severities only count towards the whole.
    known = F.when(F.col("severity").isin(SEVERITY_ORDER), F.col("severity"))
    totals = counts.groupBy(known.alias("severity")).agg(F.sum("count").alias("count"))
    shared = totals.withColumn(
        "pct", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    return (
        shared.filter(F.col("severity").isNotNull())
        .withColumn("rank", rank)
        .orderBy("rank")
        .select("severity", "count", "pct")
    )


def error_events(events: DataFrame) -> DataFrame:
    """Events whose raw severity is an error."""
    return events.filter(is_error(F.col("severity")))


def fingerprint_stats(events: DataFrame) -> DataFrame:
    """Count, first and last time of every error pattern.

    Grouped by the template itself, so that the hash is taken once per pattern.
    """
    patterns = (
        error_events(events)
        .groupBy("service", message_template(F.col("message")).alias("template"))
        .agg(
            F.count("*").alias("count"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
    )
    return patterns.select(
        fingerprint(F.col("service"), F.col("template")).alias("fingerprint"), *patterns.columns
    )


def top_errors(events: DataFrame, n: int = 10) -> DataFrame:
    return fingerprint_stats(events).orderBy(F.desc("count"), "fingerprint").limit(n)
