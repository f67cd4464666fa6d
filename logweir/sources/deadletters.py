"""Dead letters: undecodable lines with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.sources.commits import append, identity

SCHEMA = (
    "event_id STRING, raw STRING, error STRING, failed_at TIMESTAMP_NTZ, component STRING, batch BIGINT"
)


def write_batch(rows: DataFrame, path: str, batch: int, job: str) -> None:
    """Append the rows of a job's batch; a batch that is there already adds nothing."""
    numbered = rows.withColumn("batch", F.lit(batch).cast("bigint"))
    append(rows.sparkSession, path, identity(job, batch), lambda folder: numbered.write.parquet(folder))


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
