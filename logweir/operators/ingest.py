"""Requests of many events: unnest, validate, key, count outcomes, shed load."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.json import (
    evaluated_once,
    event_fields,
    event_json,
    fold_keys,
    is_malformed,
    kind,
    object_map,
    split_members,
)
from logweir.functions.text import partition_key
from logweir.functions.times import time_slice
from logweir.operators.normalize import default_event_id, default_timestamp
from logweir.operators.running import running_totals


def explode_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """One row per event of `{"events": [...]}`, with its arrival position.

    A request that is not such an object, or that holds an event of the wrong
    type, is refused as a whole: it yields one row without a position and with
    `request_error` set. A request without events yields one empty row.
    """
    kept = [c for c in requests.columns if c != body]
    parsed = evaluated_once(
        requests, _request=fold_keys(object_map(F.try_parse_json(F.col(body))))
    )
    listed = F.col("_request")["events"]
    split = evaluated_once(parsed, _listed=listed, _list=listed.try_cast("array<variant>"))
    mapped = evaluated_once(
        split,
        _events=F.transform(
            "_list", lambda e: F.struct(e.alias("root"), fold_keys(object_map(e)).alias("members"))
        ),
    )
    absent = kind(F.col("_listed")) == "VOID"
    error = (
        F.when(F.col("_request").isNull(), F.lit("unmarshal: not a request"))
        .when(~absent & F.col("_list").isNull(), F.lit("unmarshal: events is not an array"))
        .when(
            F.exists("_events", lambda e: is_malformed(e["root"], e["members"])),
            F.lit("unmarshal: malformed event"),
        )
    )
    checked = evaluated_once(mapped, request_error=error)
    good = F.when(F.col("request_error").isNull(), F.col("_events"))
    rows = checked.select(*kept, "request_error", F.posexplode_outer(good).alias("pos", "_event"))
    events = split_members(rows.withColumn("_members", F.col("_event.members")))
    return events.select(
        *kept, F.col("pos").cast("bigint").alias("pos"), *event_fields(), "request_error"
    )


def with_defaults(events: DataFrame, ingest_time: datetime | Column) -> DataFrame:
    """Fill a missing id from the content and a missing time from arrival."""
    event_id = default_event_id(F.col("event_id"), event_json(events))
    return events.withColumns(
        {
            "event_id": event_id,
            "timestamp": default_timestamp(F.col("timestamp"), ingest_time),
        }
    )


def is_valid() -> Column:
    """Service and message are required; blanks count as present."""
    return (F.coalesce("service", F.lit("")) != "") & (F.coalesce("message", F.lit("")) != "")


def validate(events: DataFrame) -> DataFrame:
    """Add `valid`; rows that stand for a request without events have none."""
    valid = is_valid()
    if "pos" in events.columns:
        valid = F.when(F.col("pos").isNotNull(), valid)
    return events.withColumn("valid", valid)


def keyed(events: DataFrame) -> DataFrame:
    """(key, value) rows of the log topic: same source, same key, same order."""
    return events.select(
        partition_key(F.col("service"), F.col("source")).alias("key"),
        event_json(events).alias("value"),
    )


def request_outcome(events: DataFrame, request: str) -> DataFrame:
    """Accepted and failed events of each request, and why it was refused as a whole, if it was."""
    valid = F.col("valid")
    return events.groupBy(request).agg(
        F.count_if(valid).alias("accepted"), F.count_if(~valid).alias("failed"), F.max("request_error").alias("refused")
    )


def service_outcome(events: DataFrame) -> DataFrame:
    """Events by service and status; rejected ones belong to no known service."""
    valid = F.col("valid")
    return events.filter(valid.isNotNull()).groupBy(
        F.when(valid, F.col("service")).otherwise("unknown").alias("service"),
        F.when(valid, "accepted").otherwise("rejected").alias("status"),
    ).agg(F.count("*").alias("events"))


def shed_over_quota(
    requests: DataFrame, quota: int, period_seconds: int = 1, slice_ms: int = 10
) -> DataFrame:
    """Mark the requests refused because their period's quota was exceeded.

    Needs `request_id`, `arrived` and `size`. A request is refused when the sizes
    before it in its period exceed the quota; it is admitted whole otherwise.
    Once one request is refused all later ones of the period are too, so the
    sum may run over every request.
    """
    micros = F.unix_micros(F.col("arrived").cast("timestamp"))
    slotted = requests.withColumns(
        {
            "period": time_slice(F.col("arrived"), period_seconds),
            "_slice": F.floor(micros / F.lit(slice_ms * 1000)).cast("bigint"),
        }
    )
    running = running_totals(
        slotted, ["period"], "_slice", ["arrived", "request_id"], {"used": F.col("size")}
    )
    before = F.col("used") - F.col("size")
    return running.select(
        "request_id", "arrived", "size", before.alias("used"), (before > quota).alias("refused")
    )
