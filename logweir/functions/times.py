"""Time helpers. Batch columns are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats: RFC 3339, and the hot table's text form with milliseconds.
RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
    r"(Z|[+-][0-9]{2}:[0-9]{2})$"
)
HOT_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}$"


def ntz(value: datetime) -> Column:
    """Literal naive UTC time; an aware time is converted."""
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def seconds(span: timedelta) -> int:
    whole = int(span.total_seconds())
    if whole <= 0 or timedelta(seconds=whole) != span:
        raise ValueError("time spans must be whole positive seconds")
    return whole


def interval(span: timedelta) -> Column:
    return F.expr(f"INTERVAL '{seconds(span)}' SECOND")


def window_text(span: timedelta) -> str:
    """Duration text for window() and withWatermark()."""
    return f"{seconds(span)} seconds"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def truncate_ms(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", ts).cast("timestamp_ntz")


def time_slice(ts: Column, slice_seconds: int) -> Column:
    """Index of the fixed-length slice of time that holds `ts`."""
    return F.floor(micros(ts) / F.lit(slice_seconds * 1_000_000)).cast("bigint")


def window_start(ts: Column, span: timedelta) -> Column:
    return F.window(ts, window_text(span))["start"]


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of a strict RFC 3339 text, NULL for anything else.

    A time in UTC is naive without its last letter, which saves looking up a zone.
    """
    utc = F.left(text, F.length(text) - 1).try_cast("timestamp_ntz")
    zoned = text.try_cast("timestamp").cast("timestamp_ntz")
    return F.when(text.rlike(RFC3339), F.when(text.endswith("Z"), utc).otherwise(zoned))


def parse_timestamp(text: Column) -> Column:
    """Hot-table text form first, RFC 3339 second, NULL when neither fits."""
    hot = F.when(text.rlike(HOT_TEXT), text.try_cast("timestamp_ntz"))
    return F.coalesce(hot, parse_rfc3339(text))


def timestamp_error(text: Column) -> Column:
    """Why a text is no timestamp; NULL for one that is, and for an absent text."""
    said = F.concat(F.lit("parsing time "), F.to_json(F.struct(text.alias("t"))), F.lit(": neither a hot-table time nor RFC 3339"))
    said = F.regexp_replace(said, r'^parsing time \{"t":(.*)\}: ', "parsing time $1: ")
    return F.when(text.isNotNull() & parse_timestamp(text).isNull(), said)
