"""Log topics: Kafka options, and file folders that stand in for a topic.

The Kafka connector is a separate Spark package. Where it is missing, files are
the same thing to every job: a `value` column of JSON lines and the time they
arrived, which stays the same when a batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators.normalize import content_id, upsert_event_attributes
from logweir.schema import LOG_COLUMNS

TOPIC_LOGS = "logs"
TOPIC_DEAD_LETTERS = "logs-dlq"
TOPIC_ALERTS = "alerts"


def kafka_source(
    spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None
) -> DataFrame:
    """Stream of a topic from its earliest offset; positions live in the checkpoint."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("value").cast("string"), F.col("timestamp").cast("timestamp_ntz").alias("arrived")
    )


def kafka_sink(records: DataFrame, servers: str, topic: str) -> None:
    """Append (key, value) rows to a topic; equal keys keep their partition."""
    (
        records.select("key", "value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def file_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of text files, oldest first."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    arrived = F.col("_metadata.file_modification_time").cast("timestamp_ntz")
    return reader.load(path).select("value", arrived.alias("arrived"))


def raw_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain log files as events: each line is a message without attributes."""
    return spark.read.text(path).select(
        F.col("value").alias("message"), F.lit("{}").alias("attributes")
    )


#: The words that a line may give as its severity.
LEVELS = (
    "trace", "debug", "information", "info", "notice", "warning", "warn",
    "error", "err", "critical", "fatal", "emergency", "emerg",
)
TIME = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?"
LINE = rf"(?is)^({TIME})[ \t]+(?:\[?({'|'.join(LEVELS)})\]?:?[ \t]+)?(.*)$"


def log_file_lines(spark: SparkSession, path: str, names: str = "*.log", stream: bool = False) -> DataFrame:
    """(value, file, arrived): the lines of all files below a folder whose names fit."""
    reader = (spark.readStream if stream else spark.read).format("text")
    lines = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("arrived"),
    )


def log_file_events(lines: DataFrame, attributes: dict[str, str] | None = None) -> DataFrame:
    """The lines of log files, (value, file), as full wire events; batch or stream.

    A line may begin with a time (UTC without an offset), and after it with a severity; a line without a time, or with
    one that does not exist, is a message as a whole, and its timestamp is NULL. The service is
    the name of the file's folder (what follows `=`, if the folder is named so). The file's name
    becomes an attribute, and `attributes` are set over it. Blank lines are no events. A file
    that is read again gives the same ids; equal lines of one file share theirs.
    """
    time = F.regexp_extract("value", LINE, 1).try_cast("timestamp").cast("timestamp_ntz")
    part = lambda k, otherwise: F.when(F.col("timestamp").isNull(), otherwise).otherwise(F.regexp_extract("value", LINE, k))
    folder = F.url_decode(F.regexp_extract("file", r"([^/=]+)/[^/]*$", 1))
    name = F.create_map(F.lit("log.file.name"), F.url_decode(F.regexp_extract("file", r"([^/]*)$", 1)))
    empty = {c: F.lit("").alias(c) for c in ("trace_id", "source", "region", "version")}
    events = lines.filter(F.col("value").rlike(r"\S")).withColumn("timestamp", time).select(
        content_id(F.concat_ws("\n", "file", "value")).alias("event_id"), "timestamp", folder.alias("service"),
        part(2, F.lit("")).alias("severity"), part(3, F.col("value")).alias("message"),
        F.to_json(name).alias("attributes"), *empty.values(),
    )
    return upsert_event_attributes(events, attributes or {}).select(*LOG_COLUMNS) if attributes else events
