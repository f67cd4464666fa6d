"""The hot table: Parquet by day, sorted by service, severity and time."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.functions.times import interval, ntz
from logweir.params import Retention
from logweir.schema import HOT_SCHEMA, LOG_COLUMNS
from logweir.sources.commits import append, compact, drop_folders, identity
from logweir.sources.commits import AppendMismatch  # noqa: F401

SORT = ["day", "service", "severity", "timestamp"]


def append_hot(rows: DataFrame, path: str, batch: int | None = None, job: str = "") -> int:
    """Append hot rows, check what was written, return how many were sent.

    A batch is known by its job and number: repeating one that is in the table adds
    nothing, batches of other jobs and plain appends (no batch) stand beside it. Within a
    day's files rows are sorted, so that Parquet statistics skip row groups by service,
    severity and time.
    """
    spark = rows.sparkSession
    sent = Observation()
    placed = (
        rows.select(*LOG_COLUMNS)
        .observe(sent, F.count("*").alias("rows"))
        .withColumn("day", F.to_date("timestamp"))
        .hint("rebalance", "day")
        .sortWithinPartitions(*SORT)
    )

    def write(folder: str) -> int:
        placed.write.partitionBy("day").parquet(folder)
        return sent.get.get("rows", 0)

    count = lambda folder: spark.read.schema(HOT_SCHEMA).parquet(folder).count()
    if append(spark, path, identity(job, batch), write, count):
        return sent.get.get("rows", 0)
    return rows.count()


def compact_day(spark: SparkSession, path: str, day: date) -> tuple[int, int]:
    """Merge the small files that many batches left for a day; returns files before and after."""

    def write(source: str, target: str) -> None:
        rows = spark.read.schema(HOT_SCHEMA).parquet(source)
        rows.hint("rebalance").sortWithinPartitions(*SORT[1:]).write.parquet(target)

    return compact(spark, path, f"day={day.isoformat()}", write)


def expire_hot(spark: SparkSession, path: str, as_of: datetime, retention: Retention = Retention()) -> list[str]:
    """Remove the day folders whose rows are all past their time to live."""
    last = (as_of - timedelta(days=retention.hot_days)).date()
    name = lambda folder: folder.removeprefix("day=")
    return drop_folders(spark, path, lambda f: f.startswith("day=") and name(f) < last.isoformat())


def read_hot(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Hot rows; a range also prunes day folders."""
    schema = T.StructType([*HOT_SCHEMA.fields, T.StructField("day", T.DateType())])
    rows = spark.read.schema(schema).parquet(path)
    if start is not None:
        rows = rows.filter((F.col("day") >= F.lit(start.date())) & (F.col("timestamp") >= ntz(start)))
    if end is not None:
        rows = rows.filter((F.col("day") <= F.lit(end.date())) & (F.col("timestamp") <= ntz(end)))
    return rows


def retained(rows: DataFrame, as_of: datetime, retention: Retention = Retention()) -> DataFrame:
    """Rows younger than the table's time to live."""
    age = interval(timedelta(days=retention.hot_days))
    return rows.filter(F.col("timestamp") > ntz(as_of) - age)
