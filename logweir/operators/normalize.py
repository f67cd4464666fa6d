"""Wire events to hot rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.json import (
    as_variant,
    attributes_text,
    redacted_text,
    upsert_attributes,
)
from logweir.functions.text import normalize_severity, redact_secrets
from logweir.functions.times import ntz, truncate_ms
from logweir.schema import DEAD_LETTER_COLUMNS, LOG_COLUMNS

COMPONENT = "processing-worker"


def _time(value: datetime | Column) -> Column:
    return value.cast("timestamp_ntz") if isinstance(value, Column) else ntz(value)


def content_id(raw: Column) -> Column:
    """Event id from content: a retried or replayed event keeps its id."""
    return F.md5(raw)


def default_event_id(event_id: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(event_id, F.lit("")), content_id(raw))


def default_timestamp(timestamp: Column, ingest_time: datetime | Column) -> Column:
    return F.coalesce(timestamp, _time(ingest_time))


def normalize(events: DataFrame, ingest_time: datetime | Column) -> DataFrame:
    """Canonical severity, redacted message and attributes, millisecond time."""
    timestamp = truncate_ms(default_timestamp(F.col("timestamp"), ingest_time))
    return events.select(
        "event_id",
        timestamp.alias("timestamp"),
        "service",
        normalize_severity(F.col("severity")).alias("severity"),
        redact_secrets(F.col("message")).alias("message"),
        redacted_text(as_variant(events)).alias("attributes"),
        *LOG_COLUMNS[6:],
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("decode_error").isNull())


def dead_letters(
    decoded: DataFrame, failed_at: datetime | Column, component: str = COMPONENT
) -> DataFrame:
    """Undecodable lines with their reason."""
    return decoded.filter(F.col("decode_error").isNotNull()).select(
        F.lit("").alias("event_id"),
        F.col("value").alias("raw"),
        F.col("decode_error").alias("error"),
        _time(failed_at).alias("failed_at"),
        F.lit(component).alias("component"),
    ).select(*DEAD_LETTER_COLUMNS)


def upsert_event_attributes(events: DataFrame, values: dict[str, str]) -> DataFrame:
    """Set fixed attributes on every event."""
    return events.withColumn(
        "attributes", attributes_text(upsert_attributes(as_variant(events), values))
    )
