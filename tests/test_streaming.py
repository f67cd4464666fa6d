import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweir.functions.json import decode_events
from logweir.operators import aggregates, detection
from logweir.operators.normalize import accepted, normalize
from logweir.schema import ALERT_COLUMNS
from logweir.sources import archive, hot
from logweir.sources.deadletters import read_dead_letters
from logweir.sources.logstream import file_source
from logweir.streaming import jobs
from test_detection import CONFIG, ERRORS, make_events

ONCE = {"availableNow": True}
DELAY = timedelta(hours=4)


def line(row):
    event_id, time, service, severity, message = row
    return json.dumps(
        {"event_id": event_id, "timestamp": time.isoformat() + "Z", "service": service, "severity": severity,
         "message": message, "attributes": {"token": "x"}}
    )


class Feed:
    """A folder that receives one file of lines at a time."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.folder = folder / "in"
        self.folder.mkdir()
        self.files = 0

    def add(self, lines):
        staged = self.folder / f".{self.files:03d}.txt"
        staged.write_text("\n".join(lines) + "\n")
        staged.rename(self.folder / f"{self.files:03d}.txt")
        self.files += 1

    def close(self):
        """An event far behind all others, with which the watermark passes them."""
        self.add([line(("end", datetime(2100, 1, 1), "_closing", "ERROR", "closing"))])

    def source(self):
        return file_source(self.spark, str(self.folder), 1)

    def events(self):
        events = accepted(decode_events(self.spark.read.text(str(self.folder))))
        return events.filter("service <> '_closing'")


@pytest.fixture(scope="module")
def rows():
    return sorted(make_events(1500), key=lambda r: (r[1], r[0]))


@pytest.fixture()
def feed(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path)
    for start in range(0, 1500, 500):
        feed.add([line(r) for r in rows[start : start + 500]] + ["{bad", f'{{"event_id":{start}}}'])
    return feed


def same(left, right):
    assert left.columns == right.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)


def test_normalize_job_restarts_without_loss_or_copies(spark, feed, tmp_path, rows):
    paths = [str(tmp_path / n) for n in ("hot", "dead", "check")]
    jobs.normalize_job(feed.source(), *paths, ONCE).awaitTermination()
    feed.add([line((f"n{i}", *r[1:])) for i, r in enumerate(rows[:50])])
    jobs.normalize_job(feed.source(), *paths, ONCE).awaitTermination()
    stored = hot.read_hot(spark, paths[0])
    same(stored.select("event_id", "timestamp", "severity", "attributes"),
         normalize(feed.events(), datetime(2024, 1, 1)).select("event_id", "timestamp", "severity", "attributes"))
    assert stored.count() == 1550
    dead = read_dead_letters(spark, paths[1])
    assert dead.count() == 6 and dead.filter("raw = '{bad'").count() == 3


def test_normalize_job_repeats_a_failed_batch(spark, feed, tmp_path, monkeypatch):
    paths = [str(tmp_path / n) for n in ("hot", "dead", "check")]
    append, calls = jobs.append_hot, []

    def fails_once(df, path, batch, job):
        append(df, path, batch, job)
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("executor lost after the append")

    monkeypatch.setattr(jobs, "append_hot", fails_once)
    with pytest.raises(Exception, match="executor lost"):
        jobs.normalize_job(feed.source(), *paths, ONCE).awaitTermination()
    jobs.normalize_job(feed.source(), *paths, ONCE).awaitTermination()
    assert calls == [0, 1, 1, 2]
    assert hot.read_hot(spark, paths[0]).count() == 1500
    assert read_dead_letters(spark, paths[1]).count() == 6


def test_archive_job_keeps_every_line(spark, feed, tmp_path):
    path = str(tmp_path / "raw")
    jobs.archive_job(feed.source(), path, str(tmp_path / "check"), ONCE).awaitTermination()
    same(archive.read_archive(spark, path).select("value"), spark.read.text(str(feed.folder)))


def run(spark, stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    jobs.write_batches(stream, out, str(tmp_path / "check"), mode, ONCE).awaitTermination()
    return spark.read.parquet(out)


def test_error_rate_windows(spark, feed, tmp_path):
    stream = jobs.error_rate_windows(jobs.event_stream(feed.source()), CONFIG, DELAY)
    updates = run(spark, stream, tmp_path, "update")
    windows = jobs.latest_updates(updates, ["service", "window_start"])
    same(windows.drop("error_rate"), detection.window_counts(feed.events(), CONFIG.window))
    alerts = jobs.window_alerts(updates, CONFIG)
    assert alerts.columns == ALERT_COLUMNS and alerts.count() > 0


def alerts_of(events):
    return aggregates.error_events(events).withColumn("error_rate", F.lit(0.5)).select(
        *detection.error_rate_alert("timestamp", 0.05, F.col("event_id"))
    )


def anchored_firing(events, config):
    """Per event, in order: what the anchored window of its service then holds."""
    out, state = set(), {}
    for r in sorted(events.collect(), key=lambda r: (r.timestamp.replace(microsecond=r.timestamp.microsecond // 1000 * 1000), r.event_id)):
        at = r.timestamp.replace(microsecond=r.timestamp.microsecond // 1000 * 1000)
        start, total, bad = state.get(r.service, (None, 0, 0))
        if start is None or at - start > config.window:
            start, total, bad = at, 0, 0
        total, bad = total + 1, bad + (r.severity in ERRORS)
        state[r.service] = start, total, bad
        if total >= config.min_events and bad / total >= config.threshold:
            out.add((f"alert-{r.service}-{r.event_id}", at, round(bad / total, 9)))
    return out


@pytest.fixture()
def late_feed(spark, tmp_path, rows):
    """Events that come up to 20 minutes late, across files."""
    rng = random.Random(11)
    late = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 20)))
    assert late != rows
    feed = Feed(spark, tmp_path)
    for start in range(0, 1500, 150):
        feed.add([line(r) for r in late[start : start + 150]])
    feed.close()
    return feed


LATE = timedelta(minutes=21)


def test_late_events_enter_the_right_anchored_window(spark, late_feed, tmp_path):
    stream = jobs.anchored_windows_stream(jobs.event_stream(late_feed.source()), CONFIG, LATE)
    query = jobs.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "check"), "append", ONCE)
    query.awaitTermination()
    assert jobs.late_rows(query) == 0
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.select("batch").distinct().count() > 2  # released as the watermark went on
    same(jobs.anchored_snapshots(stored), detection.anchored_windows(late_feed.events(), CONFIG.window))
    got = {(r.id, r.triggered_at, round(r.value, 9)) for r in jobs.anchored_alerts(stored, CONFIG).collect()}
    assert got and got == anchored_firing(late_feed.events(), CONFIG)


def test_late_errors_count_in_their_pattern(spark, late_feed, tmp_path):
    stream = jobs.recurring_errors_stream(jobs.event_stream(late_feed.source()), CONFIG, LATE)
    same(run(spark, stream, tmp_path).select(*ALERT_COLUMNS), detection.recurring_errors(late_feed.events(), CONFIG))


def test_late_alerts_cool_down_in_order(spark, late_feed, tmp_path):
    quiet = timedelta(minutes=2)
    stored = run(spark, jobs.cooldown_stream(alerts_of(jobs.event_stream(late_feed.source())), quiet, LATE), tmp_path)
    want = detection.cooldown(alerts_of(late_feed.events()), quiet)
    assert sorted(r.id for r in stored.collect()) == sorted(r.id for r in want.collect())


def test_anchored_windows(spark, feed, tmp_path):
    feed.close()
    stored = run(spark, jobs.anchored_windows_stream(jobs.event_stream(feed.source()), CONFIG, DELAY), tmp_path)
    same(jobs.anchored_snapshots(stored), detection.anchored_windows(feed.events(), CONFIG.window))
    alerts = jobs.anchored_alerts(stored, CONFIG)
    assert alerts.columns == ALERT_COLUMNS
    assert 0 < alerts.count() <= 1500


def test_recurring_errors(spark, feed, tmp_path):
    feed.close()
    stream = jobs.recurring_errors_stream(jobs.event_stream(feed.source()), CONFIG, DELAY)
    same(run(spark, stream, tmp_path).select(*ALERT_COLUMNS), detection.recurring_errors(feed.events(), CONFIG))


def test_cooldown_and_delivery(spark, feed, tmp_path):
    quiet = timedelta(minutes=2)
    feed.close()
    sent, failures = [], []

    def deliver(batch, number):
        if not failures and number == 4:
            failures.append(number)
            raise RuntimeError("webhook down")
        sent.extend(r.alert_id for r in detection.notification_payload(batch).collect())

    stream = jobs.cooldown_stream(alerts_of(jobs.event_stream(feed.source())), quiet, DELAY)
    check = str(tmp_path / "check")
    with pytest.raises(Exception, match="webhook down"):
        jobs.notify_job(stream, deliver, check, ONCE).awaitTermination()
    jobs.notify_job(stream, deliver, check, ONCE).awaitTermination()
    want = [r.id for r in detection.cooldown(alerts_of(feed.events()), quiet).collect()]
    assert sorted(sent) == sorted(want)


def test_dedup(spark, feed, tmp_path, rows):
    feed.add([line(r) for r in rows[100:900]])
    stored = run(spark, jobs.dedup_stream(jobs.event_stream(feed.source()), DELAY), tmp_path)
    assert stored.count() == 1500 and stored.select("event_id").distinct().count() == 1500


def test_late_rows_are_counted(spark, feed, tmp_path, rows):
    paths = str(tmp_path / "out"), str(tmp_path / "check")
    short = timedelta(seconds=1)

    def start():
        stream = jobs.error_rate_windows(jobs.event_stream(feed.source()), CONFIG, short)
        query = jobs.write_batches(stream, *paths, "update", ONCE)
        query.awaitTermination()
        return query

    assert jobs.late_rows(start()) == 0
    feed.add([line(("late", *rows[0][1:]))])
    assert jobs.late_rows(start()) == 1
