"""The Structured Streaming jobs, on the same operators as the batch code.

A source is any stream with `value` (a JSON line) and `arrived`, see
`sources.logstream`; its rate limit bounds a micro-batch. Sinks are written per
micro-batch under the job's identity, kept beside its checkpoint, and the batch
number: a repeated batch adds nothing, and jobs that share a table don't meet.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweir.functions.json import attributes_text, decode_events
from logweir.functions.text import fingerprint, is_error, message_template
from logweir.functions.times import seconds, window_text
from logweir.operators.aggregates import error_events
from logweir.operators.detection import error_rate_alert
from logweir.operators.normalize import accepted, dead_letters, default_timestamp, normalize
from logweir.operators.quality import has_id
from logweir.operators.spacing import from_millis, millis
from logweir.params import DetectionConfig
from logweir.schema import ALERT_COLUMNS, LOG_COLUMNS
from logweir.sources.archive import LAYOUT, write_archive
from logweir.sources.commits import job_id
from logweir.sources.deadletters import write_batch
from logweir.sources.hot import append_hot
from logweir.streaming.processors import AnchoredWindows, Cooldown, RecurringErrors, merge_instants

# Searchable within ten seconds, in files that do not become too small.
NORMALIZE_TRIGGER = {"processingTime": "5 seconds"}
ARCHIVE_TRIGGER = {"processingTime": "10 seconds"}
DETECTION_TRIGGER = {"processingTime": "5 seconds"}


def _start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict, mode: str
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None
) -> StreamingQuery:
    """Write a stream as Parquet; each row carries its micro-batch's number."""
    job = job_id(stream.sparkSession, checkpoint)

    def sink(batch: DataFrame, number: int) -> None:
        write_batch(batch, path, number, job)

    return _start(stream, sink, checkpoint, trigger or DETECTION_TRIGGER, mode)


def normalize_job(
    lines: DataFrame, hot: str, dead: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Lines to the hot table; undecodable ones to the dead letters."""
    job = job_id(lines.sparkSession, checkpoint)

    def sink(batch: DataFrame, number: int) -> None:
        decoded = decode_events(batch).persist()
        try:
            append_hot(normalize(accepted(decoded), F.col("arrived")), hot, number, job)
            write_batch(dead_letters(decoded, F.col("arrived")), dead, number, job)
        finally:
            decoded.unpersist()

    return _start(lines, sink, checkpoint, trigger or NORMALIZE_TRIGGER, "append")


def archive_job(
    lines: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
    layout: tuple[str, ...] = LAYOUT,
) -> StreamingQuery:
    """Every line, verbatim, to the archive."""
    job = job_id(lines.sparkSession, checkpoint)

    def sink(batch: DataFrame, number: int) -> None:
        write_archive(batch, path, F.col("arrived"), layout, batch=number, job=job)

    return _start(lines, sink, checkpoint, trigger or ARCHIVE_TRIGGER, "append")


def event_stream(lines: DataFrame) -> DataFrame:
    """Good events of a stream, with a zoned timestamp as watermarks need it."""
    good = accepted(decode_events(lines))
    time = default_timestamp(F.col("timestamp"), F.col("arrived")).cast("timestamp")
    return good.withColumns(
        {"timestamp": time, "attributes": attributes_text(F.col("attributes"))}
    ).select(*LOG_COLUMNS)


def error_rate_windows(
    events: DataFrame, config: DetectionConfig, delay: timedelta
) -> DataFrame:
    """Error rate per service and grid-aligned window; run it in update mode.

    Spark sums partially before the shuffle, so a busy service costs one row per
    task and window.
    """
    span = window_text(config.window)
    return (
        events.withWatermark("timestamp", window_text(delay))
        .groupBy("service", F.window("timestamp", span).alias("window"))
        .agg(F.count("*").alias("total"), F.count_if(is_error(F.col("severity"))).alias("errors"))
        .select(
            "service",
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            "total",
            "errors",
            (F.col("errors") / F.col("total")).alias("error_rate"),
        )
    )


def window_alerts(windows: DataFrame, config: DetectionConfig) -> DataFrame:
    """Alerts of updated windows that break the threshold."""
    firing = windows.filter(
        (F.col("total") >= config.min_events) & (F.col("error_rate") >= config.threshold)
    )
    suffix = F.concat_ws("-", F.unix_seconds(F.col("window_start").cast("timestamp")), "total")
    return firing.select(*error_rate_alert("window_start", config.threshold, suffix))


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows of a stream stored in update mode."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("v")
    return updates.groupBy(*keys).agg(newest).select(*keys, "v.*")


def _timed(events: DataFrame, delay: timedelta, *columns: Column | str) -> DataFrame:
    return events.withWatermark("timestamp", window_text(delay)).select(
        "timestamp", millis(F.col("timestamp")).alias("at"), *columns
    )


def anchored_windows_stream(
    events: DataFrame, config: DetectionConfig, delay: timedelta
) -> DataFrame:
    """First-event anchored windows: firing events and window snapshots."""
    rows = _timed(events, delay, "service", "event_id", is_error(F.col("severity")).alias("is_error"))
    return rows.groupBy("service").transformWithStateInPandas(
        AnchoredWindows(seconds(delay) * 1000, seconds(config.window) * 1000, config.min_events, config.threshold),
        "service STRING, start BIGINT, at BIGINT, event_id STRING, total BIGINT, errors BIGINT",
        "Append",
        "EventTime",
    )


def anchored_snapshots(stored: DataFrame) -> DataFrame:
    """Last known totals of every anchored window."""
    snapshots = stored.filter(F.col("event_id") == "").drop("event_id", "at")
    return latest_updates(snapshots, ["service", "start"]).select(
        "service", from_millis(F.col("start")).alias("window_start"), "total", "errors"
    )


def anchored_alerts(stored: DataFrame, config: DetectionConfig) -> DataFrame:
    """Alerts of the events that broke the threshold of an anchored window."""
    firing = stored.filter(F.col("event_id") != "").withColumns(
        {"error_rate": F.col("errors") / F.col("total"), "triggered_at": from_millis(F.col("at"))}
    )
    return firing.select(*error_rate_alert("triggered_at", config.threshold, F.col("event_id")))


def recurring_errors_stream(
    events: DataFrame, config: DetectionConfig, delay: timedelta
) -> DataFrame:
    """Alerts of recurring error patterns."""
    found = error_events(events).select(
        "service",
        message_template(F.col("message")).alias("template"),
        F.date_trunc("MILLISECOND", "timestamp").alias("timestamp"),
        millis(F.col("timestamp")).alias("at"),
        F.lit(1).cast("bigint").alias("n"),
    )
    merged = found.mapInPandas(merge_instants, found.schema)
    fired = (
        merged.withWatermark("timestamp", window_text(delay))
        .groupBy("service", "template")
        .transformWithStateInPandas(
            RecurringErrors(
                seconds(delay) * 1000,
                config.recurring_count,
                seconds(config.fingerprint_gap) * 1000,
                seconds(config.recurring_cooldown) * 1000,
            ),
            "service STRING, template STRING, at BIGINT, count BIGINT, first_seen BIGINT",
            "Append",
            "EventTime",
        )
    )
    key = fingerprint(F.col("service"), F.col("template"))
    return fired.select(
        F.concat(F.lit("alert-fp-"), key, F.lit("-"), "at").alias("id"),
        F.lit("recurring-error").alias("rule_id"),
        "service",
        key.alias("fingerprint"),
        F.lit("ERROR").alias("severity"),
        F.col("count").cast("double").alias("value"),
        F.concat(
            F.lit("Recurring error pattern detected "), F.col("count").cast("string"),
            F.lit(" times: "), "template",
        ).alias("message"),
        from_millis(F.col("at")).alias("triggered_at"),
        F.lit("firing").alias("status"),
    )


def cooldown_stream(alerts: DataFrame, quiet: timedelta, delay: timedelta) -> DataFrame:
    """Alerts worth a notification."""
    timed = alerts.select(
        *[F.col(c).cast("timestamp") if c == "triggered_at" else F.col(c) for c in ALERT_COLUMNS],
        millis(F.col("triggered_at")).alias("at"),
    ).withWatermark("triggered_at", window_text(delay))
    columns = {c: "DOUBLE" if c == "value" else "STRING" for c in ALERT_COLUMNS if c != "triggered_at"}
    kept = timed.groupBy("fingerprint").transformWithStateInPandas(
        Cooldown(seconds(delay) * 1000, seconds(quiet) * 1000, columns),
        "at BIGINT, " + ", ".join(f"{c} {kind}" for c, kind in columns.items()),
        "Append",
        "EventTime",
    )
    return kept.withColumn("triggered_at", from_millis(F.col("at"))).select(*ALERT_COLUMNS)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, as far as the
    query's recent progress tells."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def notify_job(
    alerts: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Hand every micro-batch of alerts to `deliver`; a failed delivery is retried
    with the batch, because the batch then does not commit."""
    return _start(alerts, deliver, checkpoint, trigger or DETECTION_TRIGGER, "append")


def dedup_stream(events: DataFrame, delay: timedelta) -> DataFrame:
    """One event per id, as far apart as the watermark delay; events without an id are all kept."""
    timed = events.withWatermark("timestamp", window_text(delay))
    named = has_id()
    return timed.filter(named).dropDuplicatesWithinWatermark(["event_id"]).unionByName(timed.filter(~named))
