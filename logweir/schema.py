"""Record shapes. A log event has three: wire, hot and cold (raw text)."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_COLUMNS = [
    "event_id",
    "timestamp",
    "service",
    "severity",
    "message",
    "attributes",
    "trace_id",
    "source",
    "region",
    "version",
]

# Columns that are left out of an event's JSON text when empty.
OPTIONAL_COLUMNS = ["attributes", "trace_id", "source", "region", "version"]

HOT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.TimestampNTZType() if name == "timestamp" else T.StringType())
        for name in LOG_COLUMNS
    ]
)

ARCHIVE_SCHEMA = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("service", T.StringType()),
    ]
)

ALERT_COLUMNS = [
    "id",
    "rule_id",
    "service",
    "fingerprint",
    "severity",
    "value",
    "message",
    "triggered_at",
    "status",
]

DEAD_LETTER_COLUMNS = ["event_id", "raw", "error", "failed_at", "component"]

RULE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("window_minutes", T.IntegerType()),
        T.StructField("min_events", T.IntegerType()),
        T.StructField("cooldown_minutes", T.IntegerType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)
