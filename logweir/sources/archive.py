"""The raw archive: verbatim JSON lines by day, hour and service."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.functions.json import (
    attributes_text,
    decode_and_route,
    decode_events,
    event_json,
    with_routing,
)
from logweir.operators.normalize import accepted, default_timestamp
from logweir.operators.search import in_range
from logweir.schema import ARCHIVE_SCHEMA, LOG_COLUMNS
from logweir.sources.commits import append, identity

UNKNOWN_SERVICE = "_unknown"
LAYOUT = ("day", "hour", "service")

# The binary source's own columns.
_FILE_FIELDS = [
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
]


def routed(lines: DataFrame, ingest_time: datetime | Column, value: str = "value") -> DataFrame:
    """Raw lines with their partition columns.

    Only service and time are read. A line without a readable service goes to
    `_unknown`, one without a time to the time of ingest. Every line is filed
    under its own time, also when a batch spans midnight.
    """
    time = default_timestamp(F.col("_time"), ingest_time)
    return with_routing(lines, value).select(
        F.col(value).alias("value"),
        F.to_date(time).alias("day"),
        F.hour(time).alias("hour"),
        _folder("_service").alias("service"),
    )


def _folder(service: str) -> Column:
    return F.coalesce(F.nullif(service, F.lit("")), F.lit(UNKNOWN_SERVICE))


def judged(lines: DataFrame, ingest_time: datetime | Column, value: str = "value") -> DataFrame:
    """Day and service by which lines are archived, `event_day` and `event_service` that they
    decode to, and `decode_error`; every line is parsed once."""
    time = default_timestamp(F.col("_time"), ingest_time)
    return decode_and_route(lines, value).select(
        F.to_date(time).alias("day"),
        _folder("_service").alias("service"),
        F.to_date("timestamp").alias("event_day"),
        _folder("service").alias("event_service"),
        "decode_error",
    )


def write_archive(
    lines: DataFrame,
    path: str,
    ingest_time: datetime | Column,
    layout: tuple[str, ...] = LAYOUT,
    batch: int | None = None,
    compression: str = "gzip",
    job: str = "",
) -> None:
    """Append raw lines to the archive.

    Rebalancing keeps one service's files together without giving all of a busy
    service to one task. A batch is known by its job and number; repeating one
    that is in the archive adds nothing.
    """
    placed = routed(lines, ingest_time).select("value", *layout)
    _write_text(placed, path, layout, identity(job, batch), compression)


def write_normalized_archive(
    events: DataFrame, path: str, layout: tuple[str, ...] = LAYOUT, compression: str = "gzip"
) -> None:
    """Archive decoded events, serialized again."""
    placed = events.select(
        event_json(events).alias("value"),
        F.to_date("timestamp").alias("day"),
        F.hour("timestamp").alias("hour"),
        "service",
    ).select("value", *layout)
    _write_text(placed, path, layout, identity("", None), compression)


def _write_text(placed: DataFrame, path: str, layout: tuple[str, ...], name: str, compression: str) -> None:
    columns = list(layout)

    def write(folder: str) -> None:
        placed.hint("rebalance", *columns).write.partitionBy(*columns).option("compression", compression).text(folder)

    append(placed.sparkSession, path, name, write)


def read_archive(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    service: str = "",
    layout: tuple[str, ...] = LAYOUT,
) -> DataFrame:
    """Raw lines of the days of a range; all of them without one.

    The day, hour and service predicates prune folders.
    """
    fields = [ARCHIVE_SCHEMA["value"], *[ARCHIVE_SCHEMA[c] for c in layout]]
    lines = spark.read.schema(T.StructType(fields)).text(path)
    if start is not None:
        lines = lines.filter(F.col("day") >= F.lit(start.date()))
    if end is not None:
        lines = lines.filter(F.col("day") <= F.lit(end.date()))
    if service and "service" in layout:
        lines = lines.filter(F.col("service") == service)
    if "hour" in layout and start is not None:
        first = F.col("day") == F.lit(start.date())
        lines = lines.filter(~first | (F.col("hour") >= start.hour))
    if "hour" in layout and end is not None:
        last = F.col("day") == F.lit(end.date())
        lines = lines.filter(~last | (F.col("hour") <= end.hour))
    return lines


def scan_archive(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    service: str = "",
    layout: tuple[str, ...] = LAYOUT,
) -> DataFrame:
    """Decoded events of the archive, attributes as JSON text; blank and
    undecodable lines are skipped.

    A compressed file is read by one task and grows many times, so the lines are dealt out
    evenly before they are decoded.
    """
    lines = read_archive(spark, path, start, end, service, layout).filter(F.col("value") != "")
    events = accepted(decode_events(lines.select("value").hint("rebalance"))).select(*LOG_COLUMNS)
    events = events.withColumn("attributes", attributes_text(F.col("attributes")))
    if start is not None and end is not None:
        events = events.filter(in_range(start, end))
    return events


def list_partitions(
    spark: SparkSession, path: str, service: str = "", layout: tuple[str, ...] = LAYOUT
) -> DataFrame:
    """Days (and services) that have data. Only file names are read: the binary
    source does not open a file whose content is not selected."""
    columns = [c for c in layout if c != "hour"]
    schema = T.StructType([*_FILE_FIELDS, *[ARCHIVE_SCHEMA[c] for c in layout]])
    days = spark.read.format("binaryFile").schema(schema).load(path).select(*columns)
    if service:
        days = days.filter(F.col("service") == service)
    return days.distinct()
