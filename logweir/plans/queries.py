"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from logweir.functions import json as fj
from logweir.functions import text as ft
from logweir.functions import times
from logweir.operators import aggregates, detection, ingest, metrics, normalize, quality, search
from logweir.params import AlertRule, SearchRequest
from logweir.plans.tables import (
    ARCHIVE_LAYOUT,
    AS_OF,
    DETECTION,
    archive,
    fill_archive,
    fresh,
    line_files,
    log_files,
    logs_dup,
    logs_hot,
    logs_raw,
    logs_wire,
    once,
    samples,
    table,
)
from logweir.schema import ALERT_COLUMNS, LOG_COLUMNS
from logweir.session import configure, workspace
from logweir.sources import archive as cold_store
from logweir.sources import hot as hot_store
from logweir.sources.deadletters import read_dead_letters
from logweir.sources.logstream import file_source, log_file_events, log_file_lines
from logweir.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query, name: str = "") -> Query:
    QUERIES[name or fn.__name__] = fn
    return fn


HOT_REQUEST = SearchRequest(
    service="billing", severity="ERROR", search="TIMED out",
    start=datetime(2024, 1, 24, 0, 0, 1), end=AS_OF, limit=20, offset=5,
)
COLD_REQUEST = SearchRequest(
    severity="critical", search="Timed OUT",
    start=datetime(2024, 1, 5, 6), end=datetime(2024, 1, 15, 18), limit=50, offset=10,
)
MERGED_REQUEST = SearchRequest(
    search="cache", start=datetime(2024, 1, 20), end=AS_OF, limit=100, offset=420
)
REQUEST_EVENTS = 20
RULES = [
    AlertRule("r1", "errors", "", "error_rate", 0.12, 1440, 20),
    AlertRule("r2", "billing errors", "billing", "error_rate", 0.05, 720, 10),
    AlertRule("r3", "volume", "", "event_volume", 40.0, 1440, 1),
    AlertRule("r4", "slow", "lookup", "latency_p99", 60.0, 1440, 5),
    AlertRule("r5", "off", "", "event_volume", 0.0, 1440, 0, enabled=False),
]


# --- sources and sinks -------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies of twenty consecutive events each."""
    wire = logs_wire(spark, sf_dir)
    number = F.col("event_id").cast("bigint")
    event = F.struct(
        "event_id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(number % 50 == 9, "").otherwise(F.col("service")).alias("service"),
        "severity",
        F.when(number % 70 == 11, "").otherwise(F.col("message")).alias("message"),
        F.try_parse_json("attributes").alias("attributes"),
        "trace_id",
        "source",
        "region",
        "version",
    )
    grouped = wire.groupBy(F.floor(number / REQUEST_EVENTS).cast("bigint").alias("request_id")).agg(
        F.array_sort(F.collect_list(F.struct(number.alias("n"), F.to_json(event).alias("event")))).alias("list"),
        F.min("timestamp").alias("arrived"),
    )
    body = F.concat(F.lit('{"events":['), F.array_join(F.col("list.event"), ","), F.lit("]}"))
    return grouped.select("request_id", "arrived", body.alias("body"))


@query
def ingest_explode(spark, sf_dir):
    return ingest.explode_requests(_requests(spark, sf_dir).drop("arrived")).select(
        "request_id", "pos", "event_id", "timestamp", "service", "severity", "message", "source"
    )


@query
def cold_scan(spark, sf_dir):
    return cold_store.scan_archive(spark, archive(spark, sf_dir), layout=ARCHIVE_LAYOUT)


@query
def cold_scan_pruned(spark, sf_dir):
    return cold_store.scan_archive(
        spark, archive(spark, sf_dir), datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 18),
        service="billing", layout=ARCHIVE_LAYOUT,
    ).select("event_id", "timestamp", "severity", "message")


@query
def scan_budget(spark, sf_dir):
    """The whole archive within a budget of a billion lines, and a row for a budget that it exceeds."""
    lines = cold_store.read_archive(spark, archive(spark, sf_dir), layout=ARCHIVE_LAYOUT)
    allowed = search.within_scan_budget(lines, 1_000_000_000).groupBy("day").agg(
        F.count("*").alias("scanned")
    ).select(F.col("day").cast("string").alias("day"), "scanned")
    try:
        refused = search.within_scan_budget(lines, 100).limit(0)
    except search.ScanBudgetExceeded:
        refused = lines.limit(1)
    return allowed.unionByName(
        refused.select(F.lit("refused").alias("day"), F.lit(100).cast("bigint").alias("scanned"))
    )


@query
def normalize_events(spark, sf_dir):
    return logs_hot(spark, sf_dir)


@query
def hot_scan(spark, sf_dir):
    return _hot(spark, sf_dir).select(*LOG_COLUMNS)


@query
def list_partitions(spark, sf_dir):
    return cold_store.list_partitions(
        spark, archive(spark, sf_dir), "billing", ARCHIVE_LAYOUT
    ).select(F.col("day").cast("string").alias("day"), "service")


@query
def replay_archive(spark, sf_dir):
    """The archive through the current parser into a fresh hot table."""
    path = fresh(spark, "replayed")
    events = cold_store.scan_archive(spark, archive(spark, sf_dir), layout=ARCHIVE_LAYOUT)
    hot_store.append_hot(normalize.normalize(events, AS_OF), path)
    return hot_store.read_hot(spark, path).select(*LOG_COLUMNS)


@query
def attribute_upsert(spark, sf_dir):
    tagged = normalize.upsert_event_attributes(
        logs_wire(spark, sf_dir), {"deployment.environment": "production", "source": "otel-collector"}
    )
    return tagged.select(
        "event_id",
        *[
            F.try_variant_get(F.try_parse_json("attributes"), path, "string").alias(name)
            for name, path in {
                "environment": "$['deployment.environment']",
                "source": "$.source",
                "k": "$.k",
                "status_code": "$['http.status_code']",
            }.items()
        ],
    )


TAGS = {"deployment.environment": "production", "source": "files"}


def _file_events(events: DataFrame) -> DataFrame:
    tag = lambda name: F.try_variant_get(F.try_parse_json("attributes"), f"$['{name}']", "string")
    return normalize.normalize(events, AS_OF).select(
        "service", "timestamp", "severity", "message", tag("deployment.environment").alias("environment"),
        tag("source").alias("source"), tag("log.file.name").endswith(".txt").alias("named"),
    )


@query
def raw_log_events(spark, sf_dir):
    """Plain log files, a folder per service, as full events."""
    return _file_events(log_file_events(log_file_lines(spark, log_files(spark, sf_dir), "*.txt"), TAGS))


@query
def stream_raw_log_events(spark, sf_dir):
    """The same files as a stream."""
    path, out = log_files(spark, sf_dir), fresh(spark, "log-events")
    events = log_file_events(log_file_lines(spark, path, "*.txt", stream=True), TAGS)
    writer = events.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint")
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return _file_events(spark.read.schema(events.schema).parquet(out))


def _hot_table(spark: SparkSession, sf_dir: str) -> str:
    return once(
        spark, sf_dir, "hot", lambda path: hot_store.append_hot(logs_hot(spark, sf_dir), path)
    )


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_store.read_hot(spark, _hot_table(spark, sf_dir)).select(*LOG_COLUMNS, "day")


@query
def hot_append(spark, sf_dir):
    path = fresh(spark, "hot")
    hot_store.append_hot(logs_hot(spark, sf_dir), path)
    return _by_day(hot_store.read_hot(spark, path))


def _by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("day").cast("string").alias("day"), "service", "severity").agg(
        F.count("*").alias("events")
    )


@query
def hot_append_two_jobs(spark, sf_dir):
    """Thirds of the rows by two jobs with the same batch number, one of them twice, and a plain append."""
    path, rows = fresh(spark, "hot"), logs_hot(spark, sf_dir)
    third = F.col("event_id").cast("bigint") % 3
    for part, job in ((0, "a"), (1, "b"), (1, "b")):
        hot_store.append_hot(rows.filter(third == part), path, batch=0, job=job)
    hot_store.append_hot(rows.filter(third == 2), path)
    return _by_day(hot_store.read_hot(spark, path))


@query
def archive_two_jobs(spark, sf_dir):
    """The same for the archive."""
    path, lines = fresh(spark, "archive"), logs_raw(spark, sf_dir)
    for part, job, batch in ((0, "a", 0), (1, "b", 0), (1, "b", 0), (2, "", None)):
        here = lines.filter(F.col("pos") % 3 == part).select("value")
        cold_store.write_archive(here, path, AS_OF, ARCHIVE_LAYOUT, batch=batch, job=job)
    return _archived(spark, path)


@query
def append_ack(spark, sf_dir):
    """Rows sent and rows found, for a batch that is written twice."""
    path = fresh(spark, "ack")
    for _ in range(2):
        sent = hot_store.append_hot(logs_hot(spark, sf_dir), path, batch=7, job="ack")
    return hot_store.read_hot(spark, path).agg(
        F.lit(sent).cast("bigint").alias("sent_rows"), F.count("*").alias("committed_rows")
    )


@query
def hot_retention(spark, sf_dir):
    rows = normalize.normalize(logs_wire(spark, sf_dir), AS_OF)
    return hot_store.retained(rows, AS_OF + timedelta(days=10)).groupBy("service").agg(
        F.count("*").alias("kept"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest")
    )


@query
def archive_write(spark, sf_dir):
    return _archived(spark, fill_archive(spark, sf_dir, fresh(spark, "archive")))


def _archived(spark: SparkSession, path: str) -> DataFrame:
    return cold_store.read_archive(spark, path, layout=ARCHIVE_LAYOUT).select(
        "value", F.col("day").cast("string").alias("day"), "service"
    )


@query
def archive_normalized(spark, sf_dir):
    path = fresh(spark, "archive-normalized")
    cold_store.write_normalized_archive(logs_hot(spark, sf_dir), path, ARCHIVE_LAYOUT)
    return cold_store.scan_archive(spark, path, layout=ARCHIVE_LAYOUT)


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fj.decode_events(logs_raw(spark, sf_dir))


@query
def dlq(spark, sf_dir):
    return normalize.dead_letters(_decoded(spark, sf_dir), AS_OF)


@query
def keyed_log(spark, sf_dir):
    return ingest.keyed(logs_wire(spark, sf_dir))


@query
def alert_records(spark, sf_dir):
    return detection.alert_records(recurring_errors(spark, sf_dir))


@query
def notification_payload(spark, sf_dir):
    return detection.notification_payload(recurring_errors(spark, sf_dir))


def _alert_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert records, those of every third second cut short."""
    alerts = recurring_errors(spark, sf_dir)
    records = detection.alert_records(alerts)
    broken = F.get_json_object("value", "$.triggered_at").try_cast("timestamp").cast("long") % 3 == 0
    return records.select("key", F.when(broken, F.expr("left(value, 20)")).otherwise(F.col("value")).alias("value"))


@query
def decode_alerts(spark, sf_dir):
    return detection.decode_alerts(_alert_topic(spark, sf_dir))


# --- projections -------------------------------------------------------------


@query
def decode_strict(spark, sf_dir):
    return _decoded(spark, sf_dir).select(
        "pos", "decode_error", "event_id", "timestamp", "service", "severity", "message", "trace_id"
    )


@query
def default_event_id(spark, sf_dir):
    wire = logs_wire(spark, sf_dir)
    gone = F.when(F.col("event_id").cast("bigint") % 10 == 0, "").otherwise(F.col("event_id"))
    raw = F.concat_ws("|", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "service", "message")
    return wire.select(
        F.col("event_id").alias("was"), normalize.default_event_id(gone, raw).alias("event_id")
    )


@query
def default_timestamp(spark, sf_dir):
    wire = logs_wire(spark, sf_dir)
    gone = F.when(F.col("event_id").cast("bigint") % 10 != 0, F.col("timestamp"))
    return wire.select("event_id", normalize.default_timestamp(gone, AS_OF).alias("timestamp"))


@query
def partition_key(spark, sf_dir):
    wire = logs_wire(spark, sf_dir)
    source = F.when(F.col("source") == "src-0", "").otherwise(F.col("source"))
    return wire.select("event_id", ft.partition_key(F.col("service"), source).alias("key"))


@query
def normalize_severity(spark, sf_dir):
    return logs_wire(spark, sf_dir).select(
        "event_id", ft.normalize_severity(F.col("severity")).alias("severity")
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of the tables: log messages, documents and conversations."""
    configure(spark)
    messages = logs_wire(spark, sf_dir).select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.col("message").alias("text")
    )
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"
    )
    turn = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), turn).alias("id"), "text"
    )
    return messages.unionByName(documents).unionByName(turns)


@query
def redact_message(spark, sf_dir):
    redacted = ft.redact_secrets(F.col("text"))
    return _texts(spark, sf_dir).select("id", F.md5(redacted).alias("digest"), F.length(redacted).alias("chars"))


@query
def message_template(spark, sf_dir):
    template = ft.message_template(F.col("text"))
    return _texts(spark, sf_dir).select("id", F.md5(template).alias("digest"), F.length(template).alias("chars"))


def _attributes(spark: SparkSession, sf_dir: str, redact: bool) -> DataFrame:
    wire = logs_wire(spark, sf_dir)
    parsed = F.try_parse_json("attributes")
    text = fj.redacted_text(parsed) if redact else fj.attributes_text(parsed)
    return wire.select("event_id", text.alias("attributes"))


@query
def redact_attributes(spark, sf_dir):
    return _attributes(spark, sf_dir, redact=True)


@query
def attributes_text(spark, sf_dir):
    rows = _attributes(spark, sf_dir, redact=False)
    gone = F.when(F.col("event_id").cast("bigint") % 11 == 0, None).otherwise(F.col("attributes"))
    return rows.select("event_id", F.coalesce(gone, F.lit("null")).alias("attributes"))


@query
def attributes_parse(spark, sf_dir):
    """Attributes stored as an object and, for odd ids, as a string that holds one."""
    wire = logs_wire(spark, sf_dir)
    odd = F.col("event_id").cast("bigint") % 2 == 1
    quoted = F.to_json(F.col("attributes").cast("variant"))
    parsed = fj.attributes_variant(F.when(odd, quoted).otherwise(F.col("attributes")))
    return wire.select(
        "event_id",
        F.try_variant_get(parsed, "$.k", "bigint").alias("k"),
        F.try_variant_get(parsed, "$['http.status_code']", "bigint").alias("status_code"),
    )


def _timestamp_text() -> Column:
    """An event's time in one of four forms, the last of which is none that counts."""
    form = F.col("event_id").cast("bigint") % 4
    return (
        F.when(form == 0, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(form == 1, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 2, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm"))
    )


@query
def parse_timestamp(spark, sf_dir):
    wire = logs_wire(spark, sf_dir)
    return wire.select("event_id", times.parse_timestamp(_timestamp_text()).alias("parsed"))


@query
def parse_timestamp_errors(spark, sf_dir):
    """Rows whose time cannot be read, with the reason."""
    told = logs_wire(spark, sf_dir).select("event_id", times.timestamp_error(_timestamp_text()).alias("error"))
    return told.filter("error IS NOT NULL")


@query
def nested_counts(spark, sf_dir):
    """Severities of every service as one JSON object."""
    nested = aggregates.nested_counts(aggregates.service_severity_counts(_hot(spark, sf_dir)))
    return nested.select("service", F.to_json("severities").alias("severities"))


@query
def fingerprint(spark, sf_dir):
    template = ft.message_template(F.col("message"))
    return logs_wire(spark, sf_dir).select("event_id", ft.fingerprint(F.col("service"), template).alias("fingerprint"))


@query
def archive_routing(spark, sf_dir):
    routed = cold_store.routed(logs_raw(spark, sf_dir), AS_OF)
    return routed.groupBy(F.col("day").cast("string").alias("day"), "hour", "service").agg(
        F.count("*").alias("lines")
    )


@query
def log_preview(spark, sf_dir):
    previews = _texts(spark, sf_dir).select(
        "id", ft.message_preview(F.col("text")).alias("preview"), F.lit("").alias("trace_id")
    )
    traced = logs_wire(spark, sf_dir).select(
        F.concat(F.lit("t"), "event_id").alias("id"), ft.message_preview(F.col("message")).alias("preview"), "trace_id"
    )
    return previews.unionByName(traced).select(
        "id", "preview", ft.trace_preview(F.col("trace_id")).alias("trace")
    )


# --- filters and search ------------------------------------------------------


@query
def filter_time(spark, sf_dir):
    req = SearchRequest(start=datetime(2024, 1, 10, 12), end=datetime(2024, 1, 11, 12))
    return search.filter_hot(_hot(spark, sf_dir), req).select("event_id", "timestamp")


@query
def filter_severity_hot(spark, sf_dir):
    req = SearchRequest(severity="FATAL").resolved(AS_OF)
    req = replace(req, start=datetime(2024, 1, 1))
    return search.filter_hot(_hot(spark, sf_dir), req).select("event_id", "severity")


@query
def filter_severity_cold(spark, sf_dir):
    req = SearchRequest(severity="WARN", start=datetime(2024, 1, 1), end=AS_OF)
    return search.filter_cold(logs_wire(spark, sf_dir), req).select("event_id", "severity")


@query
def search_text(spark, sf_dir):
    req = SearchRequest(search="Charged", start=datetime(2024, 1, 1), end=AS_OF)
    return search.filter_hot(_hot(spark, sf_dir), req).select("event_id", "message")


@query
def validate_events(spark, sf_dir):
    events = normalize.accepted(_decoded(spark, sf_dir))
    return ingest.validate(events).groupBy("valid").agg(F.count("*").alias("events")).select(
        F.col("valid").cast("string").alias("valid"), "events"
    )


@query
def error_events(spark, sf_dir):
    return aggregates.error_events(logs_wire(spark, sf_dir)).select("event_id", "service", "severity")


@query
def attribute_filter(spark, sf_dir):
    return _hot(spark, sf_dir).filter(search.attribute_at_least("http.status_code", 400)).select(
        "event_id", "service"
    )


@query
def attribute_text_filter(spark, sf_dir):
    rows = _hot(spark, sf_dir)
    exact = rows.filter(search.attribute_equals("http.status_code", "404")).select(F.lit("exact").alias("match"), "event_id")
    part = rows.filter(search.attribute_contains("api_token", "redact")).select(F.lit("part").alias("match"), "event_id")
    return exact.unionByName(part)


@query
def search_hot(spark, sf_dir):
    hot, cold = _tiers(spark, sf_dir)
    return search.search(hot, cold, HOT_REQUEST, AS_OF).page


@query
def search_total(spark, sf_dir):
    return search.total_of(search.filter_hot(_hot(spark, sf_dir), HOT_REQUEST))


def _tiers(spark: SparkSession, sf_dir: str):
    def hot(req: SearchRequest) -> DataFrame:
        return hot_store.read_hot(spark, _hot_table(spark, sf_dir), req.start, req.end)

    def cold(req: SearchRequest) -> DataFrame:
        return cold_store.scan_archive(
            spark, archive(spark, sf_dir), req.start, req.end, req.service, ARCHIVE_LAYOUT
        )

    return hot, cold


@query
def search_cold(spark, sf_dir):
    found = search.search(*_tiers(spark, sf_dir), COLD_REQUEST, AS_OF)
    return found.page.withColumn("tier", F.lit(found.source))


@query
def search_merged(spark, sf_dir):
    found = search.search(*_tiers(spark, sf_dir), MERGED_REQUEST, AS_OF)
    return found.page.withColumn("tier", F.lit(found.source))


@query
def search_merged_total(spark, sf_dir):
    return search.search(*_tiers(spark, sf_dir), MERGED_REQUEST, AS_OF).total


@query
def search_degraded(spark, sf_dir):
    """A merged search whose archive cannot be opened."""
    hot, _ = _tiers(spark, sf_dir)
    lost = f"{workspace(spark)}/no-such-archive"
    found = search.search(
        hot,
        lambda req: cold_store.scan_archive(spark, lost, req.start, req.end, layout=ARCHIVE_LAYOUT),
        replace(MERGED_REQUEST, offset=0),
        AS_OF,
    )
    return found.page.withColumn("degraded", F.lit(",".join(found.degraded)))


# --- joins -------------------------------------------------------------------


@query
def reconcile_tiers(spark, sf_dir):
    cold = cold_store.scan_archive(spark, archive(spark, sf_dir), layout=ARCHIVE_LAYOUT)
    return quality.reconcile(logs_hot(spark, sf_dir), cold)


@query
def cross_check(spark, sf_dir):
    checked = quality.cross_check_lines(
        cold_store.judged(logs_raw(spark, sf_dir).select("value"), AS_OF),
        cold_store.read_archive(spark, archive(spark, sf_dir), layout=ARCHIVE_LAYOUT),
    )
    return checked.withColumn("day", F.col("day").cast("string"))


@query
def rule_table(spark, sf_dir):
    latencies = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("value").alias("latency_ms")
    )
    events = logs_wire(spark, sf_dir).join(latencies, "event_id")
    hits = detection.evaluate_rules(events, RULES, latency="latency_ms")
    return hits.withColumn("value", F.round("value", 6))


# --- aggregations ------------------------------------------------------------


@query
def timeline_5m(spark, sf_dir):
    return aggregates.timeline(_hot(spark, sf_dir), AS_OF, hours=168)


@query
def timeline_1h(spark, sf_dir):
    return aggregates.timeline(_hot(spark, sf_dir), AS_OF, hours=720, service="billing")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.service_severity_counts(_hot(spark, sf_dir))


# Its own name is taken by the module.
query(_counts, "aggregates")


@query
def summary(spark, sf_dir):
    return aggregates.summary(_counts(spark, sf_dir)).withColumn("error_rate", F.round("error_rate", 6))


@query
def service_breakdown(spark, sf_dir):
    return aggregates.service_breakdown(_counts(spark, sf_dir)).withColumns(
        {"error_rate": F.round("error_rate", 6), "width": F.round("width", 6)}
    )


@query
def severity_distribution(spark, sf_dir):
    return aggregates.severity_distribution(_counts(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


@query
def timeline_scaled(spark, sf_dir):
    scaled = aggregates.scale_timeline(aggregates.timeline(_hot(spark, sf_dir), AS_OF, hours=720))
    return scaled.withColumns(
        {"count_share": F.round("count_share", 6), "error_share": F.round("error_share", 6)}
    )


@query
def fingerprint_stats(spark, sf_dir):
    return aggregates.fingerprint_stats(logs_wire(spark, sf_dir))


@query
def top_errors(spark, sf_dir):
    return aggregates.top_errors(logs_wire(spark, sf_dir), 5)


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate(ingest.explode_requests(_requests(spark, sf_dir)))


@query
def ingest_outcome(spark, sf_dir):
    """Some of the requests are broken, some are empty."""
    number = F.col("request_id") % 40
    requests = _requests(spark, sf_dir).withColumn(
        "body", F.when(number == 7, "{bad").when(number == 9, '{"events":[]}').otherwise(F.col("body"))
    )
    return ingest.request_outcome(ingest.validate(ingest.explode_requests(requests)), "request_id")


@query
def ingest_by_service(spark, sf_dir):
    return ingest.service_outcome(_arrivals(spark, sf_dir))


@query
def latency_stats(spark, sf_dir):
    stats = metrics.latency_stats(samples(spark, sf_dir), ["worker"])
    return stats.withColumn("avg_ms", F.round("avg_ms", 6))


@query
def rate_stats(spark, sf_dir):
    rates = metrics.rate_stats(samples(spark, sf_dir), ["worker"], 30 * 86400.0)
    return rates.select(
        "worker", "sent", "accepted", "rejected", "failed",
        *[F.round(c, 9).alias(c) for c in ("actual_rate", "accepted_rate", "acceptance_pct")],
    )


@query
def duplicate_count(spark, sf_dir):
    return quality.duplicate_count(logs_dup(spark, sf_dir))


@query
def poison_rate(spark, sf_dir):
    return quality.poison_rate(_decoded(spark, sf_dir)).withColumn("poison_rate", F.round("poison_rate", 9))


LATENCY_BOUNDS = metrics.exponential_bounds(0.001, 2.0, 10)


def _latency_buckets(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    rows = samples(spark, sf_dir).withColumns(
        {"seconds": F.col("latency_ms") / 1000.0, "day": F.date_format("ts", "yyyy-MM-dd")}
    )
    return metrics.bucket_counts(rows, keys, "seconds", LATENCY_BOUNDS)


@query
def latency_histogram(spark, sf_dir):
    finite = F.when(F.col("le") != float("inf"), F.round("le", 6)).otherwise(F.lit(-1.0))
    return _latency_buckets(spark, sf_dir, ["worker"]).withColumn("le", finite)


@query
def histogram_p95(spark, sf_dir):
    keys = ["worker", "day"]
    p95 = metrics.histogram_quantile(_latency_buckets(spark, sf_dir, keys), keys, 0.95)
    return p95.withColumn("quantile", F.round("quantile", 9))


@query
def histogram_p95_5m(spark, sf_dir):
    """p95 of the bucket counters' rates over trailing five minutes; the counters are scraped every minute and reset daily."""
    rows = samples(spark, sf_dir).select(
        "worker", (F.col("latency_ms") / 1000.0).alias("seconds"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")
    )
    since_reset = Window.partitionBy("worker", "le", F.to_date("minute")).orderBy("minute")
    scrapes = metrics.bucket_counts(rows, ["worker", "minute"], "seconds", LATENCY_BOUNDS).select(
        "worker", "le", "minute", F.sum("cumulative").over(since_reset).alias("counter")
    )
    increases = metrics.counter_increases(scrapes, ["worker", "le"], "minute", "counter")
    p95 = metrics.trailing_quantile(increases, ["worker"], 0.95, time="minute")
    return p95.filter(~F.isnan("quantile")).withColumn("quantile", F.round("quantile", 9))


@query
def event_rate_5m(spark, sf_dir):
    rates = metrics.event_rate(logs_wire(spark, sf_dir), ["service"])
    return rates.withColumn("rate", F.round("rate", 9))


# --- ordered windows ---------------------------------------------------------


@query
def running_error_rate(spark, sf_dir):
    rows = detection.running_error_rate(logs_wire(spark, sf_dir), DETECTION.window)
    return rows.drop("copies").withColumn("error_rate", F.round("error_rate", 9))


@query
def sliding_error_rate(spark, sf_dir):
    rows = detection.sliding_error_rate(logs_wire(spark, sf_dir), timedelta(hours=6))
    return rows.withColumn("error_rate", F.round("error_rate", 9))


@query
def quota_shed(spark, sf_dir):
    requests = logs_wire(spark, sf_dir).groupBy(
        F.floor(F.col("event_id").cast("bigint") / REQUEST_EVENTS).cast("bigint").alias("request_id")
    ).agg(F.min("timestamp").alias("arrived"), F.count("*").alias("size"))
    return ingest.shed_over_quota(requests, quota=60, period_seconds=6 * 3600)


@query
def last_n_samples(spark, sf_dir):
    newest = [F.desc("ts"), F.desc("event_id")]
    return metrics.last_samples(samples(spark, sf_dir), ["worker"], newest, 100).select(
        "worker", "event_id", "latency_ms"
    )


@query
def dedup_events(spark, sf_dir):
    return quality.dedup_events(logs_dup(spark, sf_dir)).select("event_id", "timestamp", "service", "message")


# --- detection ---------------------------------------------------------------


@query
def error_rate_alerts(spark, sf_dir):
    alerts = detection.error_rate_alerts(logs_wire(spark, sf_dir), DETECTION)
    return alerts.withColumn("value", F.round("value", 9))


@query
def window_state(spark, sf_dir):
    return detection.window_counts(logs_wire(spark, sf_dir), DETECTION.window)


@query
def window_state_anchored(spark, sf_dir):
    return detection.anchored_windows(logs_wire(spark, sf_dir), DETECTION.window)


@query
def window_snapshot(spark, sf_dir):
    return detection.latest_windows(detection.window_counts(logs_wire(spark, sf_dir), DETECTION.window))


@query
def recurring_errors(spark, sf_dir):
    return detection.recurring_errors(logs_wire(spark, sf_dir), DETECTION)


@query
def alert_cooldown(spark, sf_dir):
    alerts = detection.error_rate_alerts(logs_wire(spark, sf_dir), DETECTION)
    kept = detection.cooldown(alerts, DETECTION.alert_cooldown)
    return kept.select("id", "fingerprint", "triggered_at", "message")


# --- streams -----------------------------------------------------------------

ONCE = {"availableNow": True}
# No event is later than this behind one that arrived before it.
DELAY = timedelta(days=11)
# Lets the watermark pass all other events; waits in its own key for ever.
CLOSING = """{"event_id":"end","timestamp":"2100-01-01T00:00:00Z","service":"_closing","severity":"ERROR","message":"closing"}"""
CLOSING_ALERT = json.dumps({
    **dict.fromkeys(ALERT_COLUMNS, "_closing"), "value": 0.0, "triggered_at": "2100-01-01T00:00:00Z"
})


class _Run:
    """Folders and session of one streaming run over the tables' lines."""

    def __init__(self, spark: SparkSession, sf_dir: str, dup: bool = False):
        configure(spark)
        # A session of its own: state is partitioned by cores, not by the
        # caller's number of shuffle partitions.
        self.session = configure(spark.newSession())
        cores = spark.sparkContext.defaultParallelism
        self.session.conf.set("spark.sql.shuffle.partitions", str(cores))
        path, files = line_files(spark, sf_dir, dup)
        self.lines = file_source(self.session, path, files)
        self.folder = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def finished(self, build: Callable[[DataFrame], DataFrame], closing: str = CLOSING) -> DataFrame:
        """Result of the stream that `build` makes of lines, once the watermark has passed all of them.

        After the given lines the query goes on with one more, `closing`, of a far later time.
        """
        folder = self.path("closing")
        self.session.createDataFrame([], "value STRING").write.text(folder)
        stream = build(self.lines.unionByName(file_source(self.session, folder)))
        self.write(stream)
        self.session.createDataFrame([(closing,)], "value STRING").coalesce(1).write.mode("append").text(folder)
        return self.session.read.schema(stream.schema.add("batch", LongType())).parquet(self.write(stream))

    def write(self, stream: DataFrame, mode: str = "append") -> str:
        out = self.path("out")
        jobs.write_batches(stream, out, self.path("checkpoint"), mode, ONCE).awaitTermination()
        return out


@query
def stream_source(spark, sf_dir):
    run = _Run(spark, sf_dir)
    lines = spark.read.parquet(run.write(run.lines))
    return lines.agg(F.count("*").alias("lines"), F.count_distinct("value").alias("distinct_lines"))


@query
def stream_normalize(spark, sf_dir):
    run = _Run(spark, sf_dir)
    hot, dead = run.path("hot"), run.path("dead")
    jobs.normalize_job(run.lines, hot, dead, run.path("checkpoint"), ONCE).awaitTermination()
    rows = hot_store.read_hot(spark, hot).select(F.lit("hot").alias("tier"), "service", "severity")
    bad = read_dead_letters(spark, dead).select(
        F.lit("dead").alias("tier"), F.lit("").alias("service"), F.col("error").alias("severity")
    )
    return rows.unionByName(bad).groupBy("tier", "service", "severity").agg(F.count("*").alias("events"))


@query
def stream_archive(spark, sf_dir):
    run = _Run(spark, sf_dir)
    path = run.path("archive")
    jobs.archive_job(run.lines, path, run.path("checkpoint"), ONCE, ARCHIVE_LAYOUT).awaitTermination()
    lines = cold_store.read_archive(spark, path, layout=ARCHIVE_LAYOUT)
    return lines.groupBy("service").agg(
        F.count("*").alias("lines"), F.count_distinct("value").alias("distinct_lines")
    )


@query
def stream_error_rate(spark, sf_dir):
    run = _Run(spark, sf_dir)
    windows = jobs.error_rate_windows(jobs.event_stream(run.lines), DETECTION, DELAY)
    updates = spark.read.parquet(run.write(windows, "update"))
    return jobs.latest_updates(updates, ["service", "window_start"]).drop("error_rate")


@query
def stream_window_state(spark, sf_dir):
    run = _Run(spark, sf_dir)
    build = lambda lines: jobs.anchored_windows_stream(jobs.event_stream(lines), DETECTION, DELAY)
    return jobs.anchored_snapshots(run.finished(build))


@query
def stream_anchored_alerts(spark, sf_dir):
    """Alerts of every event that leaves its anchored window over the threshold, however late it came."""
    run = _Run(spark, sf_dir)
    build = lambda lines: jobs.anchored_windows_stream(jobs.event_stream(lines), DETECTION, DELAY)
    return jobs.anchored_alerts(run.finished(build), DETECTION)


@query
def stream_error_alerts(spark, sf_dir):
    """Alerts of windows over the threshold, as the last update of each window has it."""
    run = _Run(spark, sf_dir)
    windows = jobs.error_rate_windows(jobs.event_stream(run.lines), DETECTION, DELAY)
    updates = spark.read.parquet(run.write(windows, "update"))
    return jobs.window_alerts(jobs.latest_updates(updates, ["service", "window_start"]), DETECTION)


@query
def stream_recurring(spark, sf_dir):
    run = _Run(spark, sf_dir)
    build = lambda lines: jobs.recurring_errors_stream(jobs.event_stream(lines), DETECTION, DELAY)
    return run.finished(build).drop("batch")


@query
def stream_cooldown(spark, sf_dir):
    """Every error event as an alert of its service, at most one per quarter hour."""
    run = _Run(spark, sf_dir)

    def build(lines: DataFrame) -> DataFrame:
        errors = aggregates.error_events(jobs.event_stream(lines))
        alerts = errors.withColumn("error_rate", F.lit(1.0)).select(
            *detection.error_rate_alert("timestamp", DETECTION.threshold, F.col("event_id"))
        )
        return jobs.cooldown_stream(alerts, DETECTION.alert_cooldown, DELAY)

    return run.finished(build).select("id", "fingerprint", "triggered_at")


@query
def stream_notifications(spark, sf_dir):
    """The alert topic through decoding and cooldown to what is sent."""
    run = _Run(spark, sf_dir)
    topic = run.path("alerts")
    _alert_topic(spark, sf_dir).select("value").write.text(topic)
    run.lines = file_source(run.session, topic, 1)

    def build(records: DataFrame) -> DataFrame:
        alerts = detection.decode_alerts(records).filter("error IS NULL")
        return jobs.cooldown_stream(alerts, DETECTION.alert_cooldown, DELAY)

    return detection.notification_payload(run.finished(build, CLOSING_ALERT).select(*ALERT_COLUMNS))


@query
def stream_dedup(spark, sf_dir):
    run = _Run(spark, sf_dir, dup=True)
    events = jobs.dedup_stream(jobs.event_stream(run.lines), DELAY)
    out = run.write(events.select("event_id", "timestamp", "service"))
    return spark.read.parquet(out).select(
        "event_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "service"
    )
