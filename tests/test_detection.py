import math
import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.functions.chain import block_steps, spaced_positions, step
from logweir.operators import detection, metrics
from logweir.operators.running import running_totals
from logweir.operators.spacing import spaced
from logweir.params import AlertRule, DetectionConfig

START = datetime(2024, 1, 1)
ERRORS = ("ERROR", "FATAL", "CRITICAL")
CONFIG = DetectionConfig(
    window=timedelta(minutes=5), min_events=20, threshold=0.1, recurring_count=15,
    recurring_cooldown=timedelta(minutes=3), idle_gap=timedelta(minutes=4),
)


def make_events(n=3000, seed=1):
    """One service holds most rows, many of them in the same instant; with gaps."""
    rng = random.Random(seed)
    rows, clock = [], 0
    for i in range(n):
        clock += rng.choice([0, 0, 1, 250, 1500, 4000]) + (300_000 if i % 700 == 699 else 0)
        service = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c"])
        severity = rng.choice(["ERROR", "CRITICAL", "err", "INFO", "INFO", "WARNING", "INFO", "INFO"])
        message = rng.choice(["timeout after 12 ms", "timeout after 99 ms", "refused from 10.0.0.1"])
        rows.append((f"{i:06d}", START + timedelta(milliseconds=clock), service, severity, message))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_events()


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(
        rows, "event_id STRING, timestamp TIMESTAMP_NTZ, service STRING, severity STRING, message STRING"
    ).repartition(4)


def greedy(times, gap, strict):
    kept = []
    for t in sorted(times):
        if not kept or (t - kept[-1] > gap if strict else t - kept[-1] >= gap):
            kept.append(t)
    return kept


def test_chain_boundaries():
    times = np.array([0, 899, 900, 901, 1800, 1801])
    assert spaced_positions(times, 900, False, None) == [0, 2, 4]
    assert spaced_positions(times, 900, True, None) == [0, 3]
    assert spaced_positions(times, 900, False, 1) == [3, 5]
    assert spaced_positions(np.array([], dtype="int64"), 900, False, None) == []


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(("minutes", "gap"), [(30, 60), (1, 60), (1, 300), (2, 7)])
def test_spacing_by_blocks_of_any_length(spark, rows, strict, minutes, gap):
    times = [(r[2], int((r[1] - START).total_seconds() * 1000)) for r in rows]
    df = spark.createDataFrame(times, "service STRING, at BIGINT")
    got = {}
    for r in spaced(df, ["service"], timedelta(seconds=gap), strict, minutes).collect():
        got.setdefault(r.service, []).append(r["at"])
    want = {s: greedy([t for x, t in times if x == s], gap * 1000, strict) for s in {t[0] for t in times}}
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("strict", [False, True])
def test_steps_of_blocks_are_what_the_chain_does(strict):
    rng = np.random.default_rng(5)
    for _ in range(200):
        gap, begin = int(rng.integers(1, 60)), 1000
        times = np.unique(rng.integers(begin, begin + rng.integers(2, 300), rng.integers(1, 80)))
        starts, lasts = block_steps(times, begin, gap, strict)
        assert (np.diff(starts) > 0).all() and (np.diff(lasts) != 0).all()
        for last in [None, *range(begin - gap - 3, begin)]:
            kept = spaced_positions(times, gap, strict, last)
            assert step(starts, lasts, gap, strict, last) == (int(times[kept[-1]]) if kept else last)


def test_steps_of_dense_blocks_are_few_where_chains_meet():
    times = np.unique(np.random.default_rng(1).integers(0, 1_800_000, 20_000))
    starts, _ = block_steps(times, 0, 60_000, False)
    assert len(starts) < 100  # of some 670 first times


def test_spacing_holds_no_key_in_one_task(spark):
    rows = spark.range(200_000).select(F.lit(None).cast("string").alias("k"), (F.col("id") * 997 + 17).alias("at"))
    got = sorted(r["at"] for r in spaced(rows, ["k"], timedelta(seconds=5), block_minutes=1).collect())
    assert got == greedy(range(17, 200_000 * 997, 997), 5000, False)
    plan = spaced(rows, ["k"], timedelta(seconds=5))._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.splitlines() if "InPandas" in line]
    assert len(grouped) == 2 and all("block" in line for line in grouped)


def test_running_totals_in_any_slicing(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab"), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "k STRING, o INT, v BIGINT")
    for width in (1, 7, 1000):
        sliced = df.withColumn("slice", F.floor(F.col("o") / width))
        got = {(r.k, r.o): r.total for r in running_totals(sliced, ["k"], "slice", ["o"], {"total": F.col("v")}).collect()}
        sums, want = {}, {}
        for k, o, v in data:
            want[k, o] = sums[k] = sums.get(k, 0) + v
        assert got == want


def test_running_totals_shuffle_the_rows_once(spark, events):
    placed = events.withColumn("slice", F.unix_seconds(F.col("timestamp").cast("timestamp")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = running_totals(placed, ["service"], "slice", ["timestamp", "event_id"], {"n": F.lit(1)})
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Rows by (service, slice); totals by the same, by service, and back.
    rows_moved = [line for line in text.splitlines() if "Exchange hashpartitioning(service" in line]
    assert len(rows_moved) == 4, text


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


def grid(time, span):
    return START + ((time - START) // span) * span


def test_running_error_rate(events, rows):
    state, want = {}, {}
    for eid, time, service, severity, _ in in_order(rows):
        key = (service, grid(time, CONFIG.window))
        total, bad = state.get(key, (0, 0))
        state[key] = (total + 1, bad + (severity in ERRORS))
        want[eid] = (key[1], *state[key])
    running = detection.running_error_rate(events, CONFIG.window, slice_seconds=3)
    got = {r.event_id: (r.window_start, r.total, r.errors) for r in running.collect()}
    assert got == want
    alerts = {r.id.rsplit("-", 1)[1]: r for r in detection.error_rate_alerts(events, CONFIG).collect()}
    firing = {e for e, (_, t, b) in want.items() if t >= 20 and b / t >= 0.1}
    assert set(alerts) == firing and firing
    for eid, alert in alerts.items():
        rate = want[eid][2] / want[eid][1]
        assert alert.value == rate
        assert alert.message == (
            f"Error rate {rate * 100:.2f}% exceeds threshold 10.00% for service {alert.service}"
        )
    counts = {(r.service, r.window_start): (r.total, r.errors) for r in detection.window_counts(events, CONFIG.window).collect()}
    assert counts == state
    latest = {r.service: r.window_start for r in detection.latest_windows(detection.window_counts(events, CONFIG.window)).collect()}
    assert latest == {s: max(w for x, w in state if x == s) for s in {k[0] for k in state}}


def test_copies_count_at_once(spark, events):
    doubled = events.unionByName(events.filter("event_id = '000005'"))
    once = {r.event_id: r.total for r in detection.running_error_rate(events, CONFIG.window).collect()}
    rows = {r.event_id: r for r in detection.running_error_rate(doubled, CONFIG.window).collect()}
    assert rows["000005"].copies == 2 and rows["000005"].total == once["000005"] + 1
    assert len(rows) == len(once)


def test_sliding_error_rate(events, rows):
    window = timedelta(seconds=40)
    got = {(r.service, r.timestamp): (r.total, r.errors) for r in detection.sliding_error_rate(events, window, slice_seconds=7).collect()}
    times = sorted({(r[2], r[1]) for r in rows})
    assert set(got) == set(times)
    for service, time in times[::17]:
        inside = [r for r in rows if r[2] == service and time - window <= r[1] <= time]
        assert got[service, time] == (len(inside), sum(r[3] in ERRORS for r in inside))


@pytest.mark.parametrize("minutes", [30, 1])
def test_anchored_windows(events, rows, minutes):
    windows = {}
    start = {}
    for _, time, service, severity, _ in in_order(rows):
        if service not in start or time - start[service] > CONFIG.window:
            start[service] = time
        key = (service, start[service])
        total, bad = windows.get(key, (0, 0))
        windows[key] = (total + 1, bad + (severity in ERRORS))
    got = detection.anchored_windows(events, CONFIG.window, block_minutes=minutes)
    assert {(r.service, r.window_start): (r.total, r.errors) for r in got.collect()} == windows


def template(message):
    message = re.sub(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>", message)
    return re.sub(r"\b\d+\b", "<N>", message)


def simulate_recurring(rows, config):
    """The per-event state machine: count since first seen, forget when idle."""
    entries, fired = {}, []
    for _, time, service, severity, message in in_order(rows):
        if severity not in ERRORS:
            continue
        key = (service, template(message))
        entry = entries.get(key)
        if entry is None or time - entry["last"] > config.fingerprint_gap:
            entry = entries[key] = {"count": 0, "alerted": None}
        entry["count"] += 1
        entry["last"] = time
        quiet = entry["alerted"] is None or time - entry["alerted"] > config.recurring_cooldown
        if entry["count"] > config.recurring_count and quiet:
            entry["alerted"] = time
            fired.append((*key, time, float(entry["count"])))
    return fired


@pytest.mark.parametrize(("slice_seconds", "minutes"), [(10, 30), (1, 1), (10_000, 30)])
def test_recurring_errors(events, rows, slice_seconds, minutes):
    got = detection.recurring_errors(events, CONFIG, slice_seconds, minutes).collect()
    want = simulate_recurring(rows, CONFIG)
    assert want
    assert sorted((r.service, r.triggered_at, r.value) for r in got) == sorted((s, t, v) for s, _, t, v in want)
    for r in got:
        assert r.message.startswith(f"Recurring error pattern detected {int(r.value)} times: ")
        assert r.fingerprint.startswith(r.service + ":") and r.status == "firing"


def test_rules_of_all_lengths_read_the_events_once(spark, events, monkeypatch):
    rules = [AlertRule("v", "n", "", "event_volume", 1.0, 5, 1), AlertRule("w", "n", "", "event_volume", 1.0, 15, 1),
             AlertRule("e", "n", "", "error_rate", 0.0, 10, 1), AlertRule("p", "n", "", "latency_p99", 0.0, 15, 1)]
    timed = events.withColumn("latency_ms", F.length("message").cast("double"))
    read = []
    plain = detection.stored
    monkeypatch.setattr(detection, "stored", lambda df: read.append(df) or plain(df))
    hits = detection.evaluate_rules(timed, rules, "latency_ms")
    (panes,) = read
    assert panes.columns == ["service", "pane", "latency", "total", "errors"]
    assert "Scan ExistingRDD" in (plan := hits._jdf.queryExecution().executedPlan().toString()) and "Scan parquet" not in plan
    for rule in rules[:2]:
        want = detection.window_counts(events, timedelta(minutes=rule.window_minutes))
        got = hits.filter(F.col("rule_id") == rule.id).select("service", "window_start", "total")
        assert sorted(map(tuple, got.collect())) == sorted((r.service, r.window_start, r.total) for r in want.collect())


def test_percentiles_of_dense_ranges_and_weights(spark):
    rng = np.random.default_rng(4)
    dense = 1000 + rng.random(4000) * 1e-3  # one slice of the number line holds them all
    rows = [("d", float(x), 1) for x in dense] + [("w", float(x), int(n)) for x, n in zip(rng.normal(size=300), rng.integers(1, 9, 300))]
    rows += [("same", 7.0, 5), ("odd", float("nan"), 1), ("odd", float("-inf"), 2), ("odd", float("inf"), 1), ("none", None, 3)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE, n BIGINT")
    ranks = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.k: r for r in metrics.order_statistics(df, ["k"], "v", ranks, weight="n").collect()}
    assert set(got) == {"d", "w", "same", "odd"}
    for k in ("d", "w", "same"):
        values = sorted(v for key, v, n in rows if key == k for _ in range(n))
        assert [got[k][n] for n in ranks] == [values[int(len(values) * p)] for p in ranks.values()]
    assert got["odd"].p0 == float("-inf") and got["odd"].p50 == float("inf") and math.isnan(got["odd"].p95)


def test_cooldown(spark):
    quarter = timedelta(minutes=15)
    offsets = [0, 1, 14 * 60 + 59, 15 * 60, 15 * 60 + 1, 30 * 60 + 1, 90 * 60]
    rows = [
        (f"{fp}{i}", "r", "s", fp, "ERROR", 1.0, "m", START + timedelta(seconds=o), "firing")
        for fp in ("x", "y") for i, o in enumerate(offsets) if fp == "x" or i != 0
    ]
    df = spark.createDataFrame(
        rows,
        "id STRING, rule_id STRING, service STRING, fingerprint STRING, severity STRING, value DOUBLE,"
        " message STRING, triggered_at TIMESTAMP_NTZ, status STRING",
    )
    kept = {r.id for r in detection.cooldown(df.unionByName(df), quarter).collect()}
    assert kept == {"x0", "x3", "x5", "x6", "y1", "y4", "y5", "y6"}
    payload = detection.notification_payload(df)
    assert payload.columns[:3] == ["alert_id", "service", "rule"]
    assert {r.key for r in detection.alert_records(df).collect()} == {"x", "y"}


def test_rules(spark, events):
    timed = events.withColumn("latency_ms", F.length("message").cast("double"))
    rules = [
        AlertRule("all", "n", "", "error_rate", 0.1, 5, 20),
        AlertRule("hot", "n", "hot", "event_volume", 10.0, 5, 0),
        AlertRule("slow", "n", "a", "latency_p99", 1.0, 10, 0),
        AlertRule("off", "n", "", "event_volume", 0.0, 5, 0, enabled=False),
    ]
    hits = detection.evaluate_rules(timed, rules, "latency_ms").collect()
    by_rule = {}
    for h in hits:
        by_rule.setdefault(h.rule_id, []).append(h)
    assert set(by_rule) == {"all", "hot", "slow"}
    assert {h.service for h in by_rule["hot"]} == {"hot"} and {h.service for h in by_rule["slow"]} == {"a"}
    windows = detection.window_counts(events, timedelta(minutes=5)).collect()
    assert len(by_rule["all"]) == sum(w.total >= 20 and w.errors / w.total >= 0.1 for w in windows)
    with pytest.raises(ValueError):
        detection.evaluate_rules(events, [AlertRule("x", "n", "", "cpu", 1.0)])
    with pytest.raises(ValueError):
        detection.evaluate_rules(events, rules)


def test_percentiles(spark):
    rng = random.Random(5)
    data = [("one", 5.0)] + [("flat", 1.0)] * 300 + [("wide", rng.uniform(-50, 5000)) for _ in range(997)]
    data += [("hundred", float(i)) for i in range(100)]
    df = spark.createDataFrame(data, "worker STRING, latency_ms DOUBLE")
    got = {r.worker: r for r in metrics.latency_stats(df, ["worker"]).collect()}
    for worker in ("one", "flat", "wide", "hundred"):
        values = sorted(v for w, v in data if w == worker)
        row = got[worker]
        assert row.samples == len(values) and (row.min_ms, row.max_ms) == (values[0], values[-1])
        assert [row.p50_ms, row.p95_ms, row.p99_ms] == [values[int(len(values) * p)] for p in (0.5, 0.95, 0.99)]
    assert got["hundred"].p50_ms == 50.0
    overall = metrics.latency_stats(df, []).collect()[0]
    assert overall.p95_ms == sorted(v for _, v in data)[int(len(data) * 0.95)]
    empty = metrics.latency_stats(df.limit(0), []).collect()[0]
    assert (empty.samples, empty.p50_ms, empty.max_ms) == (0, 0.0, 0.0)


def test_nan_sorts_last(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, float("nan"), 2.0, -3.0)], "worker STRING, latency_ms DOUBLE")
    row = metrics.latency_stats(df, ["worker"]).first()
    assert row.p50_ms == 2.0 and math.isnan(row.p99_ms)


@pytest.mark.parametrize("slice_seconds", [60, 3600])
def test_counters_that_reset(spark, slice_seconds):
    rng = random.Random(8)
    rows, want = [], {}
    for k in "ab":
        value, before = 0, None
        for i in sorted(rng.sample(range(4000), 200)):
            value = rng.randint(0, 3) if rng.random() < 0.1 else value + rng.randint(0, 9)
            at = START + timedelta(seconds=i)
            want[k, at] = value - before if before is not None and value >= before else value
            rows.append((k, at, value))
            before = value
    df = spark.createDataFrame(rows + rows[:5], "k STRING, at TIMESTAMP_NTZ, v BIGINT")
    got = {(r.k, r["at"]): r.increase for r in metrics.counter_increases(df, ["k"], "at", "v", slice_seconds).collect()}
    assert got == want


def test_trailing_quantile_follows_the_window(spark):
    early, late = START, START + timedelta(minutes=3)
    # Up to 1 s: 10 early events; up to 2 s: those and 10 late ones.
    rows = [("a", 1.0, early, 10), ("a", 2.0, early, 10), ("a", float("inf"), early, 10),
            ("a", 1.0, late, 0), ("a", 2.0, late, 10), ("a", float("inf"), late, 10)]
    df = spark.createDataFrame(rows, "k STRING, le DOUBLE, timestamp TIMESTAMP_NTZ, increase BIGINT")
    got = {r.window_end: r.quantile for r in metrics.trailing_quantile(df, ["k"], 0.5).collect()}
    minute = lambda n: START.replace(second=0, microsecond=0) + timedelta(minutes=n)
    assert [got[minute(n)] for n in range(1, 9)] == [0.5, 0.5, 0.5, 1.0, 1.0, 1.5, 1.5, 1.5]


def test_histogram_quantile(spark):
    data = [("a", 0.5)] * 50 + [("a", 1.5)] * 40 + [("a", 99.0)] * 10 + [("b", 0.2)] * 10
    df = spark.createDataFrame(data, "k STRING, v DOUBLE")
    bounds = metrics.exponential_bounds(1.0, 2.0, 3)
    assert bounds == [1.0, 2.0, 4.0]
    buckets = metrics.bucket_counts(df, ["k"], "v", bounds)
    q = {r.k: r.quantile for r in metrics.histogram_quantile(buckets, ["k"], 0.8).collect()}
    assert q == {"a": 1.75, "b": 0.8}
    assert {r.k: r.quantile for r in metrics.histogram_quantile(buckets, ["k"], 0.95).collect()}["a"] == 4.0


def test_event_rate(spark):
    rows = [("a", START + timedelta(seconds=s)) for s in (0, 59, 60, 400)]
    df = spark.createDataFrame(rows, "service STRING, timestamp TIMESTAMP_NTZ")
    got = {r.window_end: r.rate * 300 for r in metrics.event_rate(df, ["service"]).collect()}
    minute = timedelta(minutes=1)
    assert {(k - START) // minute: round(v) for k, v in got.items()} == {
        1: 2, 2: 3, 3: 3, 4: 3, 5: 3, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1
    }
    with pytest.raises(ValueError):
        metrics.event_rate(df, ["service"], timedelta(minutes=5), timedelta(minutes=2))


def test_last_samples_limit_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("worker"), F.col("id").alias("ts"))
    last = metrics.last_samples(df, ["worker"], [F.desc("ts")], 1000)
    assert last.groupBy("worker").count().collect()[0]["count"] == 1000
    assert last.agg(F.min("ts")).first()[0] == 3000
    assert last._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_rate_stats_and_report(spark, tmp_path):
    df = spark.createDataFrame(
        [("w", 10, 8, 1, 1), ("w", 10, 10, 0, 0), ("idle", 0, 0, 0, 0)],
        "worker STRING, sent BIGINT, accepted BIGINT, rejected BIGINT, failed BIGINT",
    )
    rates = metrics.rate_stats(df, ["worker"], 4.0)
    got = {r.worker: (r.actual_rate, r.accepted_rate, r.acceptance_pct) for r in rates.collect()}
    assert got == {"w": (5.0, 4.5, 90.0), "idle": (0.0, 0.0, 0.0)}
    metrics.write_report(rates, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
