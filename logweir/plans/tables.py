"""The registered queries' input: the given tables seen as service logs.

The mapping is plain SQL that Spark and DuckDB read alike, so an oracle starts
from the very same rows.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators.normalize import normalize
from logweir.params import DetectionConfig
from logweir.session import configure, workspace
from logweir.sources.archive import write_archive
from logweir.sources.hot import retained

AS_OF = datetime(2024, 1, 31)
CUTOFF = AS_OF - timedelta(days=7)
# The tables hold few events per service and minute, hence wide windows.
DETECTION = DetectionConfig(
    window=timedelta(days=1),
    min_events=20,
    threshold=0.05,
    recurring_count=20,
    idle_gap=timedelta(days=2),
)
# One folder level less than the default: the tables span 720 hours.
ARCHIVE_LAYOUT = ("day", "service")
# So that a task that is late or larger holds up little.
TASKS_A_CORE = 4

WIRE_SQL = """
SELECT CAST(event_id AS STRING) AS event_id, ts AS timestamp,
  CASE user_id % 10 WHEN 0 THEN 'billing' WHEN 1 THEN 'login' WHEN 2 THEN 'stock'
    WHEN 3 THEN 'dispatch' WHEN 4 THEN 'mailer' WHEN 5 THEN 'profiles'
    WHEN 6 THEN 'baskets' WHEN 7 THEN 'lookup' WHEN 8 THEN 'hints'
    ELSE 'reports' END AS service,
  CASE event_type
    WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'err' WHEN 1 THEN ' Error ' ELSE 'CRITICAL' END
    WHEN 'signup' THEN 'information' WHEN 'purchase' THEN 'Warn' WHEN 'view' THEN 'trace'
    ELSE CASE event_id % 2 WHEN 0 THEN '' ELSE 'notice' END END AS severity,
  CASE event_type
    WHEN 'error' THEN concat('billing ', substr(md5(CAST(event_id AS STRING)), 1, 12),
      ' timed out after ', CAST(event_id % 5000 AS STRING), ' ms from 10.0.',
      CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING),
      ' token=', CAST(event_id AS STRING))
    WHEN 'signup' THEN concat('user', CAST(user_id AS STRING), '@example.com authenticated')
    WHEN 'purchase' THEN concat('card 4111-1111-1111-',
      substr(CAST(10000 + event_id % 10000 AS STRING), 2, 4), ' charged')
    WHEN 'view' THEN 'no cached value for key'
    ELSE 'request finished' END AS message,
  CASE WHEN event_id % 7 = 0 THEN concat('{"http.status_code":',
      CAST(200 + event_id % 300 AS STRING), ',"api_token":"t', CAST(event_id AS STRING), '"}')
    ELSE props END AS attributes,
  CASE WHEN event_type = 'error' THEN substr(md5(CAST(event_id AS STRING)), 1, 16) ELSE '' END AS trace_id,
  concat('src-', CAST(user_id % 4 AS STRING)) AS source,
  'us-east-1' AS region, '1.0.0' AS version
FROM events
"""

# Lines with known faults by number: 0 broken, 1 trailing garbage, 2 numeric id,
# 3 time not RFC 3339, 4 attributes an array; 5 decodes but has no service.
RAW_SQL = """
SELECT CAST(event_id AS BIGINT) AS pos, timestamp AS event_time,
  CASE CAST(event_id AS BIGINT) % 100
    WHEN 0 THEN '{{bad'
    ELSE concat('{{"event_id":',
      CASE WHEN CAST(event_id AS BIGINT) % 100 = 2 THEN event_id ELSE concat('"', event_id, '"') END,
      ',"timestamp":"', CASE WHEN CAST(event_id AS BIGINT) % 100 = 3
        THEN {plain} ELSE {iso} END,
      '","service":"', CASE WHEN CAST(event_id AS BIGINT) % 100 = 5 THEN '' ELSE service END,
      '","severity":"', severity, '","message":"', message, '","attributes":',
      CASE WHEN CAST(event_id AS BIGINT) % 100 = 4 THEN '[1]' ELSE attributes END,
      ',"trace_id":"', trace_id, '","source":"', source,
      '","region":"', region, '","version":"', version, '"}}',
      CASE WHEN CAST(event_id AS BIGINT) % 100 = 1 THEN ' x' ELSE '' END)
  END AS value
FROM {logs}
"""

DUP_SQL = """
SELECT * FROM {logs}
UNION ALL
SELECT * FROM {logs} WHERE CAST(event_id AS BIGINT) % 20 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the partitions that the session's file settings give it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, text: str, source: DataFrame) -> DataFrame:
    """Run SQL whose \\0 stands for the source; its braces are JSON text."""
    text = text.replace("{", "{{").replace("}", "}}").replace("\0", "{source}")
    return spark.sql(text, source=source)


def logs_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wire(spark, table(spark, sf_dir, "events"))


def _wire(spark: SparkSession, events: DataFrame) -> DataFrame:
    configure(spark)
    return _sql(spark, WIRE_SQL.replace("FROM events", "FROM \0"), events)


def _raw(spark: SparkSession, logs: DataFrame) -> DataFrame:
    text = RAW_SQL.format(
        plain="date_format(timestamp, 'yyyy-MM-dd HH:mm:ss')",
        iso="date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
        logs="\0",
    )
    return _sql(spark, text, logs)


def logs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines, from events that are dealt out evenly first.

    A row group is read by one task whatever the number of cores. Its events become lines of
    many times their size, which are parsed where they are made.
    """
    return _raw(spark, _wire(spark, _dealt(spark, table(spark, sf_dir, "events"))))


def _dealt(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The events in several tasks for each core, and no fewer than they are read in."""
    tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, events.rdd.getNumPartitions())
    return events.repartition(tasks, "event_id", "ts")


def logs_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dup(spark, logs_wire(spark, sf_dir))


def _dup(spark: SparkSession, logs: DataFrame) -> DataFrame:
    return _sql(spark, DUP_SQL.format(logs="\0"), logs)


def logs_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(normalize(logs_wire(spark, sf_dir), AS_OF), AS_OF)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request samples: latency and outcome by worker."""
    events = table(spark, sf_dir, "events")
    failed = (F.col("event_type") == "error").cast("bigint")
    return events.select(
        (F.col("user_id") % 10).alias("worker"),
        F.col("ts"),
        "event_id",
        F.col("value").alias("latency_ms"),
        F.lit(1).cast("bigint").alias("sent"),
        (1 - failed).alias("accepted"),
        failed.alias("rejected"),
        F.lit(0).cast("bigint").alias("failed"),
    )


_written: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Path of a derived table of this application, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        folder = sf_dir.strip("/").replace("/", "_")
        path = f"{workspace(spark)}/{folder}/{name}"
        write(path)
        _written[key] = path
    return _written[key]


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder for one run of a query whose work is the writing."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def fill_archive(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The raw lines as an archive."""
    write_archive(logs_raw(spark, sf_dir).select("value"), path, AS_OF, ARCHIVE_LAYOUT)
    return path


def archive(spark: SparkSession, sf_dir: str) -> str:
    return once(spark, sf_dir, "archive", lambda path: fill_archive(spark, sf_dir, path))


def line_files(
    spark: SparkSession, sf_dir: str, duplicates: bool = False, parts: int = 3
) -> tuple[str, int]:
    """The raw lines as text files that arrive in `parts` steps of event time.

    Returns the folder and the number of files of a step, which a trigger has to
    take together: within a step files have no order.
    """
    logs = logs_wire(spark, sf_dir)
    lines = _raw(spark, _dup(spark, logs) if duplicates else logs)
    files = lines.rdd.getNumPartitions()

    def write(path: str) -> None:
        first = datetime(2024, 1, 1)
        step = (AS_OF - first) / parts
        number = F.floor((F.unix_micros(F.col("event_time").cast("timestamp"))
                          - F.unix_micros(F.lit(first))) / F.lit(step // timedelta(microseconds=1)))
        # Events before or after the month belong to the outer steps.
        number = F.least(F.greatest(number, F.lit(0)), F.lit(parts - 1))
        for i in range(parts):
            here = lines.filter(number == i).select("value").repartition(files)
            here.write.mode("append").text(path)

    name = "lines_dup" if duplicates else "lines"
    return once(spark, sf_dir, name, write), files


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """The events as plain log files, a folder per service; every tenth line has no time, every next one a time in seconds."""
    logs = logs_wire(spark, sf_dir)
    kind = F.col("event_id").cast("bigint") % 10
    time = F.when(kind == 1, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).when(
        kind != 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )
    level = F.when(kind != 0, F.nullif(F.trim("severity"), F.lit("")))
    lines = logs.select(F.col("service").alias("folder"), F.concat_ws(" ", time, level, "message").alias("value"))
    return once(spark, sf_dir, "log-files", lambda path: lines.write.partitionBy("folder").text(path))
