"""Error-rate windows, recurring error patterns, rules and alert cooldown.

All times are event times, so that a replay gives the same alerts. Errors are
judged by the raw severity, exactly as written by the producer.
"""

from __future__ import annotations

from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.functions.text import fingerprint, fixed2, is_error, message_template
from logweir.functions.times import from_micros, interval, micros, parse_rfc3339, seconds, time_slice, window_start
from logweir.operators.aggregates import error_events
from logweir.operators.metrics import order_statistics
from logweir.operators.running import running_totals
from logweir.operators.spacing import BLOCK_MINUTES, from_millis, millis, spaced
from logweir.params import AlertRule, DetectionConfig
from logweir.schema import ALERT_COLUMNS, RULE_SCHEMA
from logweir.session import stored

# Seconds per slice of the ordered sums; a slice of one service is one task's share.
SLICE_SECONDS = 10
MAX_RULES = 10_000


def _counts(by: list[Column | str], events: DataFrame) -> DataFrame:
    return events.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(is_error(F.col("severity"))).alias("errors")
    )


def _rate() -> Column:
    return F.col("errors") / F.col("total")


def window_counts(events: DataFrame, window: timedelta) -> DataFrame:
    """Total and error events per service and window, windows on a fixed grid."""
    start = window_start(F.col("timestamp"), window).alias("window_start")
    return _counts(["service", start], events)


def latest_windows(windows: DataFrame) -> DataFrame:
    """The current window of every service."""
    newest = F.max_by(F.struct("window_start", "total", "errors"), "window_start")
    return windows.groupBy("service").agg(newest.alias("w")).select("service", "w.*")


def running_error_rate(
    events: DataFrame, window: timedelta, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """State of the window after each event, in (timestamp, event_id) order.

    Redelivered copies of an event are merged first and count at once, so one row
    stands for all copies and carries their number.
    """
    merged = events.groupBy("service", "timestamp", "event_id").agg(
        F.count("*").alias("copies"), F.count_if(is_error(F.col("severity"))).alias("error_copies")
    )
    placed = merged.withColumns(
        {
            "window_start": window_start(F.col("timestamp"), window),
            "_slice": time_slice(F.col("timestamp"), slice_seconds),
        }
    )
    running = running_totals(
        placed,
        ["service", "window_start"],
        "_slice",
        ["timestamp", "event_id"],
        {"total": F.col("copies"), "errors": F.col("error_copies")},
    )
    return running.select(
        "service", "window_start", "timestamp", "event_id", "copies", "total", "errors",
        _rate().alias("error_rate"),
    )


def error_rate_alerts(events: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """An alert for every event after which its window is over the threshold."""
    firing = running_error_rate(events, config.window).filter(
        (F.col("total") >= config.min_events) & (F.col("error_rate") >= config.threshold)
    )
    return firing.select(*error_rate_alert("timestamp", config.threshold, F.col("event_id")))


def error_rate_alert(time: str, threshold: float, suffix: Column) -> list[Column]:
    """Alert columns from service, error_rate and a time column."""
    limit = f"{threshold * 100:.2f}"
    return [
        F.concat(F.lit("alert-"), "service", F.lit("-"), suffix).alias("id"),
        F.lit("error-rate-threshold").alias("rule_id"),
        F.col("service"),
        F.concat(F.lit("error_rate_"), "service").alias("fingerprint"),
        F.lit("WARNING").alias("severity"),
        F.col("error_rate").alias("value"),
        F.concat(
            F.lit("Error rate "),
            fixed2(F.col("error_rate") * 100),
            F.lit(f"% exceeds threshold {limit}% for service "),
            F.col("service"),
        ).alias("message"),
        F.col(time).alias("triggered_at"),
        F.lit("firing").alias("status"),
    ]


def sliding_error_rate(
    events: DataFrame, window: timedelta, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Error rate of the `window` before and at every time an event occurs.

    The count in a sliding window is the running count now less the running count
    when the window began. Both come from one ordered sum over the events and,
    shifted by the window, their probes; no frame is ever re-read.
    """
    points = _counts(["service", "timestamp"], events)
    now = points.select("service", "timestamp", F.col("timestamp").alias("at"), F.lit(1).alias("kind"),
                        "total", "errors")
    began = points.select(
        "service", "timestamp", (F.col("timestamp") - interval(window)).alias("at"),
        F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("errors"),
    )
    both = now.unionByName(began).withColumn("_slice", time_slice(F.col("at"), slice_seconds))
    # At equal times the probe comes first: the window includes its first instant.
    running = running_totals(
        both, ["service"], "_slice", ["at", "kind", "timestamp"],
        {"_total": F.col("total"), "_errors": F.col("errors")},
    )
    sign = F.when(F.col("kind") == 1, 1).otherwise(-1)
    return (
        running.groupBy("service", "timestamp")
        .agg(F.sum(sign * F.col("_total")).alias("total"), F.sum(sign * F.col("_errors")).alias("errors"))
        .withColumn("error_rate", _rate())
    )


def anchored_windows(
    events: DataFrame, window: timedelta, block_minutes: int = BLOCK_MINUTES
) -> DataFrame:
    """Windows that start at a service's first event and again at the first one
    that is older than the window, at millisecond precision."""
    instants = stored(_counts(["service", millis(F.col("timestamp")).alias("at")], events))
    starts = spaced(instants, ["service"], window, strict=True, block_minutes=block_minutes)
    span = seconds(window) * 1000
    # A start serves its own cell of time and the next; starts lie more than a
    # cell apart, so every instant finds exactly one.
    cell = F.floor(F.col("at") / span).cast("bigint")
    reach = starts.select(
        "service", F.col("at").alias("start"), F.explode(F.array(cell, cell + 1)).alias("cell")
    )
    found = instants.withColumn("cell", cell).join(reach, ["service", "cell"]).filter(
        F.col("at").between(F.col("start"), F.col("start") + span)
    )
    return (
        found.groupBy("service", "start")
        .agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))
        .select("service", from_millis(F.col("start")).alias("window_start"), "total", "errors")
    )


def recurring_errors(
    events: DataFrame,
    config: DetectionConfig = DetectionConfig(),
    slice_seconds: int = SLICE_SECONDS,
    block_minutes: int = BLOCK_MINUTES,
) -> DataFrame:
    """Alerts for error patterns seen more than `recurring_count` times.

    A pattern's count runs from its first occurrence until it has been idle for
    longer than the gap, and it alerts again only after the cooldown. Counts are
    kept per slice of time; only slices past the limit are looked into.
    """
    gap_ms = seconds(config.fingerprint_gap) * 1000
    slice_ms = min(slice_seconds * 1000, gap_ms)
    pattern = ["service", "template"]
    instants = (
        error_events(events)
        .groupBy(
            "service",
            message_template(F.col("message")).alias("template"),
            millis(F.col("timestamp")).alias("at"),
        )
        .agg(F.count("*").alias("n"))
        .withColumn("slice", F.floor(F.col("at") / slice_ms).cast("bigint"))
    )
    slices = instants.groupBy(*pattern, "slice").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.sum("n").alias("n")
    )
    in_order = Window.partitionBy(*pattern).orderBy("slice")
    before = (
        Window.partitionBy(*pattern, "session")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    idle = F.col("first") - F.lag("last").over(in_order)
    sessions = (
        slices.withColumn("fresh", F.coalesce(idle > gap_ms, F.lit(True)).cast("bigint"))
        .withColumn("session", F.sum("fresh").over(in_order))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .filter(F.col("before") + F.col("n") > config.recurring_count)
        .select(*pattern, "slice", "session", "before")
    )
    inside = (
        Window.partitionBy(*pattern, "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = instants.join(sessions, [*pattern, "slice"]).withColumn(
        "prior", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    over = stored(counted.filter(F.col("prior") + F.col("n") > config.recurring_count))
    kept = spaced(
        over, [*pattern, "session"], config.recurring_cooldown, strict=True, block_minutes=block_minutes
    )
    # Of several occurrences in one instant the first over the limit fires.
    count = F.greatest(F.col("prior"), F.lit(config.recurring_count)) + 1
    key = fingerprint(F.col("service"), F.col("template"))
    fired = over.join(kept, [*pattern, "session", "at"])
    return fired.select(
        F.concat(F.lit("alert-fp-"), key, F.lit("-"), "at").alias("id"),
        F.lit("recurring-error").alias("rule_id"),
        "service",
        key.alias("fingerprint"),
        F.lit("ERROR").alias("severity"),
        count.cast("double").alias("value"),
        F.concat(
            F.lit("Recurring error pattern detected "), count.cast("string"), F.lit(" times: "), "template"
        ).alias("message"),
        from_millis(F.col("at")).alias("triggered_at"),
        F.lit("firing").alias("status"),
    )


def cooldown(alerts: DataFrame, quiet: timedelta, block_minutes: int = BLOCK_MINUTES) -> DataFrame:
    """Drop an alert when its fingerprint was let through less than `quiet` ago."""
    first = F.min_by(F.struct(*ALERT_COLUMNS), "id").alias("alert")
    timed = alerts.withColumn("at", millis(F.col("triggered_at")))
    instants = stored(timed.groupBy("fingerprint", "at").agg(first))
    kept = spaced(instants, ["fingerprint"], quiet, block_minutes=block_minutes)
    return instants.join(kept, ["fingerprint", "at"]).select("alert.*")


def notification_payload(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.col("id").alias("alert_id"),
        "service",
        F.col("rule_id").alias("rule"),
        "severity",
        "message",
        "value",
        "fingerprint",
        "triggered_at",
        "status",
    )


def alert_records(alerts: DataFrame) -> DataFrame:
    """(key, value) rows of the alert topic."""
    stamp = F.date_format("triggered_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("triggered_at")
    fields = [stamp if c == "triggered_at" else F.col(c) for c in ALERT_COLUMNS]
    return alerts.select(F.col("fingerprint").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def decode_alerts(records: DataFrame, value: str = "value") -> DataFrame:
    """Alerts of the alert topic. A record that is no alert keeps its other columns
    and says so in `error`; whoever notifies skips it."""
    text = "STRING"
    kinds = {c: "DOUBLE" if c == "value" else text for c in ALERT_COLUMNS}
    schema = ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", _bad STRING"
    parsed = F.from_json(value, schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    others = [c for c in records.columns if c != value]
    rows = records.select(*others, parsed.alias("_alert"))
    time = parse_rfc3339(F.col("_alert.triggered_at"))
    good = F.col("_alert").isNotNull() & F.col("_alert._bad").isNull() & time.isNotNull()
    fields = [F.when(good, time if c == "triggered_at" else F.col(f"_alert.{c}")).alias(c) for c in ALERT_COLUMNS]
    return rows.select(*others, *fields, F.when(~good, F.lit("unmarshal: not an alert")).alias("error"))


def rules_table(spark: SparkSession, rules: list[AlertRule]) -> DataFrame:
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return spark.createDataFrame([tuple(vars(r).values()) for r in rules], RULE_SCHEMA)


def evaluate_rules(
    events: DataFrame, rules: list[AlertRule], latency: str | None = None
) -> DataFrame:
    """Windows that break an enabled rule, with the value that broke it.

    Events are read once, into panes of the longest length that divides all windows; the
    windows of every rule are rolled up from these. `latency` names the latency column that latency_p99 rules need.
    """
    spark = events.sparkSession
    active = [r for r in rules if r.enabled]
    known = {"error_rate", "event_volume", "latency_p99"}
    if unknown := {r.condition for r in active} - known:
        raise ValueError(f"unknown rule conditions: {sorted(unknown)}")
    if not active:
        raise ValueError("no enabled rules")
    timed = [r for r in active if r.condition == "latency_p99"]
    if timed and latency is None:
        raise ValueError("latency_p99 rules need a latency column")
    lengths = sorted({r.window_minutes for r in active})
    panes = stored(_panes(events, gcd(*lengths), latency if timed else None))
    keys = ["service", "window_minutes", "window_start"]
    values = _rolled(panes, lengths).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))
    values = values.withColumn("error_rate", _rate())
    if timed:
        held = _rolled(panes, sorted({r.window_minutes for r in timed}))
        p99 = order_statistics(held, keys, "latency", {"p99": 0.99}, weight="total")
        values = values.join(p99, keys, "left")
    else:
        values = values.withColumn("p99", F.lit(None).cast("double"))
    # At most MAX_RULES rows, so the rules can go to every task.
    table = F.broadcast(rules_table(spark, active).withColumnRenamed("service", "rule_service"))
    # A window answers to the rules of its service and to those for all services.
    scopes = F.array_distinct(F.array("service", F.lit("")))
    value = (
        F.when(F.col("condition") == "error_rate", F.col("error_rate"))
        .when(F.col("condition") == "event_volume", F.col("total").cast("double"))
        .otherwise(F.col("p99"))
    )
    return (
        values.withColumn("rule_service", F.explode(scopes))
        .join(table, ["rule_service", "window_minutes"])
        .withColumn("value", value)
        .filter((F.col("total") >= F.col("min_events")) & (F.col("value") >= F.col("threshold")))
        .select(
            F.col("id").alias("rule_id"), "condition", "service",
            from_micros(F.col("window_start")).alias("window_start"), "total", "value", "threshold",
        )
    )


def _panes(events: DataFrame, minutes: int, latency: str | None) -> DataFrame:
    """Events and errors per service, pane of time and latency: all that windows of multiples of the pane need."""
    width = minutes * 60_000_000
    at = micros(F.col("timestamp"))
    value = F.col(latency).cast("double") if latency else F.lit(None).cast("double")
    return _counts(["service", (at - F.pmod(at, F.lit(width))).alias("pane"), value.alias("latency")], events)


def _rolled(panes: DataFrame, lengths: list[int]) -> DataFrame:
    """Each pane in the window of every length that holds it."""
    length = F.explode(F.array(*[F.lit(n) for n in lengths])).alias("window_minutes")
    width = F.col("window_minutes").cast("bigint") * F.lit(60_000_000)
    return panes.select("*", length).withColumn("window_start", F.col("pane") - F.pmod("pane", width))
