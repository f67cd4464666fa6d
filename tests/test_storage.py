import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweir.functions.json import decode_events
from logweir.operators import quality
from logweir.operators.normalize import accepted, normalize
from logweir.params import Retention
from logweir.sources import archive, commits, hot
from logweir.schema import LOG_COLUMNS
from logweir.sources.logstream import log_file_events, log_file_lines, raw_log_lines

NOW = datetime(2024, 1, 31, 12)


def raw(n=60, services=("a", "b/c", "012"), start=datetime(2024, 1, 1, 22)):
    out = []
    for i in range(n):
        time = start + timedelta(minutes=7 * i)
        out.append(
            json.dumps({"event_id": f"e{i}", "timestamp": time.isoformat() + "Z", "service": services[i % 3],
                        "severity": "info", "message": f"m {i}"})
        )
    return out


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value STRING")


def test_archive_round_trip(spark, tmp_path):
    lines = raw() + ["{bad", '{"service":5}', '{"service":""}', '{"service":"a"} x', '  {"service": "a"}  ']
    path = str(tmp_path / "raw")
    archive.write_archive(frame(spark, lines), path, NOW)
    stored = archive.read_archive(spark, path)
    assert sorted(r.value for r in stored.collect()) == sorted(lines)
    placed = {(str(r.day), r.hour, r.service) for r in stored.filter("value LIKE '%e16\"%'").collect()}
    assert placed == {("2024-01-01", 23, "b/c")}
    unknown = {r.value for r in stored.filter("service = '_unknown'").collect()}
    assert unknown == {"{bad", '{"service":5}', '{"service":""}', '{"service":"a"} x'}
    assert {(str(r.day), r.hour) for r in stored.filter("service = '_unknown'").collect()} == {("2024-01-31", 12)}
    found = archive.scan_archive(spark, path, datetime(2024, 1, 1, 23, 50), datetime(2024, 1, 2, 0, 10))
    assert sorted(r.event_id for r in found.select("event_id").collect()) == ["e16", "e17", "e18"]
    assert archive.scan_archive(spark, path).count() == len(raw()) + 2
    parts = {(str(r.day), r.service) for r in archive.list_partitions(spark, path, "012").collect()}
    assert parts == {("2024-01-01", "012"), ("2024-01-02", "012")}


def test_archive_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "raw")
    archive.write_archive(frame(spark, raw(400)), path, NOW)
    lines = archive.read_archive(spark, path, datetime(2024, 1, 2, 5), datetime(2024, 1, 3, 7), service="a")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "day#" in pruned and "hour#" in pruned and "service#" in pruned
    got = {(str(r.day), r.hour, r.service) for r in lines.collect()}
    assert got == {("2024-01-02", h, "a") for h in range(5, 24)} | {("2024-01-03", h, "a") for h in range(8)}


def test_archive_batch_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "raw")
    lines = frame(spark, raw())
    for _ in range(2):
        archive.write_archive(lines, path, NOW, batch=3, job="j")
    archive.write_archive(frame(spark, raw(3)), path, NOW, batch=4, job="j")
    assert archive.read_archive(spark, path).count() == 63


def events(spark, n=60):
    return accepted(decode_events(frame(spark, raw(n))))


def test_normalized_archive(spark, tmp_path):
    path = str(tmp_path / "norm")
    rows = normalize(events(spark), NOW)
    archive.write_normalized_archive(rows, path)
    back = archive.scan_archive(spark, path)
    assert sorted(map(tuple, back.select("event_id", "timestamp", "severity", "message").collect())) == sorted(
        map(tuple, rows.select("event_id", "timestamp", "severity", "message").collect())
    )


def test_hot_append_replaces_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = normalize(events(spark), NOW)
    for _ in range(2):
        assert hot.append_hot(rows, path, 1, "j") == 60
    assert hot.append_hot(rows.limit(5), path, 2, "j") == 5
    assert hot.append_hot(rows.limit(0), path, 3, "j") == 0
    assert hot.read_hot(spark, path).count() == 65


def test_jobs_and_plain_appends_share_a_table(spark, tmp_path):
    path, lines = str(tmp_path / "hot"), str(tmp_path / "raw")
    rows = normalize(events(spark), NOW)
    for job in ("a", "b", "b"):
        hot.append_hot(rows, path, 0, job)
        archive.write_archive(frame(spark, raw()), lines, NOW, batch=0, job=job)
    for _ in range(2):
        hot.append_hot(rows.limit(5), path)
        archive.write_archive(frame(spark, raw(5)), lines, NOW)
    assert hot.read_hot(spark, path).count() == 130
    assert archive.read_archive(spark, lines).count() == 130
    assert archive.scan_archive(spark, lines).count() == 130
    with pytest.raises(ValueError, match="needs the job"):
        hot.append_hot(rows, path, 1)


def test_an_attempt_that_broke_off_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "hot")
    rows = normalize(events(spark), NOW)
    moved = commits._Folder.move

    def breaks(self, old, new):
        if new.endswith(".done"):
            raise OSError("driver lost")
        moved(self, old, new)

    monkeypatch.setattr(commits._Folder, "move", breaks)
    with pytest.raises(OSError, match="driver lost"):
        hot.append_hot(rows, path, 0, "j")
    monkeypatch.setattr(commits._Folder, "move", moved)
    hot.append_hot(rows, path, 0, "j")
    assert hot.read_hot(spark, path).count() == 60


def test_compaction_bounds_the_files_of_a_day(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = normalize(events(spark), NOW).filter("timestamp < '2024-01-02'")
    for batch in range(6):
        hot.append_hot(rows, path, batch, "j")
    before, after = hot.compact_day(spark, path, datetime(2024, 1, 1).date())
    assert before >= 6 and after == 1
    hot.append_hot(rows, path, 5, "j")  # still known
    assert hot.read_hot(spark, path).count() == 6 * rows.count()


def test_expired_days_are_removed(spark, tmp_path):
    path = str(tmp_path / "hot")
    hot.append_hot(normalize(events(spark, 1000), NOW), path)
    kept = hot.read_hot(spark, path).filter("timestamp >= '2024-01-03'").count()
    gone = hot.expire_hot(spark, path, datetime(2024, 2, 2, 12), Retention(hot_days=30))
    assert gone == ["day=2024-01-01", "day=2024-01-02"]
    assert hot.read_hot(spark, path).count() == kept


def test_hot_append_checks_what_arrived(spark, tmp_path, monkeypatch):
    rows = normalize(events(spark), NOW)
    monkeypatch.setattr(hot.Observation, "get", {"rows": 61})
    with pytest.raises(hot.AppendMismatch, match="60 of 61 rows"):
        hot.append_hot(rows, str(tmp_path / "hot"))


def test_hot_range_prunes_days(spark, tmp_path):
    path = str(tmp_path / "hot")
    hot.append_hot(normalize(events(spark, 1000), NOW), path)
    rows = hot.read_hot(spark, path, datetime(2024, 1, 3), datetime(2024, 1, 3, 12)).filter("service = 'a'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(service,a)" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert {r.d for r in rows.select(F.to_date("timestamp").alias("d")).distinct().collect()} == {
        datetime(2024, 1, 3).date()
    }


def test_retention(spark):
    rows = normalize(events(spark, 10), NOW)
    first = rows.agg(F.min("timestamp")).first()[0]
    kept = hot.retained(rows, first + timedelta(days=30), Retention())
    assert kept.count() == 9


def test_reconcile_and_duplicates(spark):
    cold = events(spark)
    copies = cold.unionByName(cold.limit(1)).select("event_id", "timestamp", "service")
    hot_rows = cold.filter("event_id != 'e3'").select("event_id").unionByName(
        spark.createDataFrame([("stray",)], "event_id STRING")
    )
    status = {r.status: (r.events, r.hot_rows, r.cold_rows) for r in quality.reconcile(hot_rows, copies).collect()}
    assert status == {"both": (59, 59, 60), "hot_only": (1, 1, 0), "cold_only": (1, 0, 1)}
    assert [r.event_id for r in quality.missing_events(copies, hot_rows).collect()] == ["e3"]
    counts = quality.duplicate_count(copies).first()
    assert (counts.rows, counts.distinct_ids, counts.duplicates) == (61, 60, 1)
    assert quality.approximate_duplicates(copies).first().rows == 61
    assert quality.dedup_events(copies).count() == 60


def test_events_without_an_id_are_not_copies(spark):
    rows = spark.createDataFrame(
        [("", 1, "a"), ("", 1, "b"), (None, 2, "c"), ("x", 3, "z"), ("x", 3, "d"), ("x", 2, "e")],
        "event_id STRING, timestamp INT, message STRING",
    )
    assert sorted(r.message for r in quality.dedup_events(rows).collect()) == ["a", "b", "c", "e"]


def test_dedup_takes_ids_of_any_type(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 1, "c"), (None, 1, "d"), (None, 1, "d")], "event_id BIGINT, timestamp INT, message STRING")
    assert sorted(r.message for r in quality.dedup_events(rows).collect()) == ["b", "c", "d", "d"]


def test_dedup_limits_copies_before_the_shuffle(spark):
    plan = quality.dedup_events(spark.range(10_000).select((F.col("id") % 3).alias("event_id"), F.col("id").alias("timestamp")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_raw_log_lines(spark, tmp_path):
    (tmp_path / "app.log").write_text("first\nsecond\n")
    assert sorted(r.message for r in raw_log_lines(spark, str(tmp_path)).collect()) == ["first", "second"]


def test_log_file_events(spark, tmp_path):
    folder = tmp_path / "in" / "pay ments"
    folder.mkdir(parents=True)
    (folder / "a b.log").write_text(
        "2024-01-02T03:04:05.5+01:00 [Error]: no funds\n\n"
        "2024-01-02 03:04:05\tstarted\n2024-13-02T03:04:05Z ERROR x\n  at frame 1\n2024-01-02T03:04:05Z \n"
        "2024-01-02T03:04:05Z informationless\n"
    )
    (folder / "other.txt").write_text("not read\n")
    got = log_file_events(log_file_lines(spark, str(tmp_path / "in")), {"env": "x", "log.file.name": "y"})
    rows = {r.message: r for r in got.collect()}
    assert got.columns == LOG_COLUMNS and len({r.event_id for r in rows.values()}) == 6
    assert {m: (r.severity, r.timestamp and r.timestamp.isoformat()) for m, r in rows.items()} == {
        "no funds": ("Error", "2024-01-02T02:04:05.500000"),
        "started": ("", "2024-01-02T03:04:05"),
        "2024-13-02T03:04:05Z ERROR x": ("", None),
        "  at frame 1": ("", None),
        "": ("", "2024-01-02T03:04:05"),
        "informationless": ("", "2024-01-02T03:04:05"),
    }
    assert {(r.service, r.attributes) for r in rows.values()} == {("pay ments", '{"env":"x","log.file.name":"y"}')}
    plain = log_file_events(log_file_lines(spark, str(tmp_path / "in")))
    assert {r.attributes for r in plain.collect()} == {'{"log.file.name":"a b.log"}'}

    out = str(tmp_path / "out")
    stream = log_file_events(log_file_lines(spark, str(tmp_path / "in"), stream=True))
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(map(str, spark.read.schema(stream.schema).parquet(out).collect())) == sorted(map(str, plain.collect()))
