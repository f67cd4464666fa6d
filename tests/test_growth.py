"""What keeps the cost of a row from growing with the number of its uses."""

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from logweir.functions import json as fj
from logweir.functions.times import parse_rfc3339
from logweir.operators import normalize, quality
from logweir.plans import tables
from logweir.plans.queries import QUERIES
from logweir.sources import archive as cold_store
from logweir.streaming import processors
from conftest import SF_DIR

NOW = datetime(2024, 1, 31)
LINES = [
    '{"event_id":"1","timestamp":"2024-01-02T03:04:05Z","service":"a","message":"m"}',
    '{"event_id":"2","timestamp":"2024-01-02T23:30:00-01:00","SERVICE":"a","ser\u017fice":"b"}',
    '{"event_id":"3","timestamp":"2024-01-02T03:04:05Z","service":"a"} x',
    '{"event_id":4,"timestamp":"2024-01-02T03:04:05Z","service":"a"}',
    '{"event_id":"5","timestamp":"yesterday","service":"a"}',
    '{"event_id":"6","service":7}', '{"event_id":"7"}', '{"event_id":"8","timestamp":null,"service":""}',
    '{"event_id":"9","timestamp":"2024-01-02T03:04:05Z","service":"a","attributes":[1]}',
    '{"event_id":"9","timestamp":"0001-01-01T00:00:00Z","service":"a","attributes":null}',
    "null", "[]", "{bad", "", None,
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cross_check_parses_every_line_once(spark):
    assert plan(QUERIES["cross_check"](spark, SF_DIR)).count("parseJson(") == 1


def test_cross_check_of_lines_equals_that_of_their_fates(spark):
    lines = spark.createDataFrame([(x,) for x in LINES * 3], "value STRING")
    kept = lines.where("value NOT LIKE '%\"7\"%'")  # one is missing from the archive
    decoded = fj.decode_events(lines)
    processed = normalize.accepted(decoded).select(
        F.to_date("timestamp").alias("day"),
        F.coalesce(F.nullif("service", F.lit("")), F.lit(cold_store.UNKNOWN_SERVICE)).alias("service"),
    )
    dead = normalize.dead_letters(decoded, NOW).select(F.col("raw").alias("value"))
    archived = cold_store.routed(kept, NOW)
    one = quality.cross_check_lines(cold_store.judged(lines, NOW), archived)
    four = quality.cross_check(cold_store.routed(lines, NOW), processed, cold_store.routed(dead, NOW), archived)
    rows = [sorted(map(str, df.collect())) for df in (one, four)]
    assert rows[0] == rows[1] and "balanced=False" in "".join(rows[0])


def test_one_pass_decodes_and_routes_like_two(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value STRING")
    both = fj.decode_and_route(lines)
    plain = lambda df: sorted(str(r) for r in df.withColumn("attributes", fj.attributes_text(F.col("attributes"))).collect())
    assert plain(both.drop("_service", "_time")) == plain(fj.decode_events(lines))
    same = lambda df: sorted(str(r) for r in df.select("value", "_service", "_time").collect())
    assert same(both) == same(fj.with_routing(lines))


def test_no_lambda_keeps_the_reading_of_members_from_being_compiled(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value STRING")
    for df in (cold_store.routed(lines, NOW), fj.decode_events(lines)):
        loose = [line for line in plan(df).splitlines() if "Generate" in line and "*(" not in line]
        assert not loose


def test_times_with_and_without_an_offset(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456789Z", "2024-01-02T03:04:05+02:00", "2024-02-30T03:04:05Z",
             "2024-01-02T24:00:00Z", "2024-01-02T03:04:60Z", "0000-01-01T00:00:00Z", "2024-01-02T03:04:05", "Z", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    zoned = F.try_to_timestamp("t").cast("timestamp_ntz")
    got = df.select(parse_rfc3339(F.col("t")).cast("string").alias("got"), zoned.cast("string").alias("want"), F.col("t").rlike("(Z|:00)$").alias("fits"))
    for r in got.collect():
        assert r.got == (r.want if r.fits and r.want else None) or not r.fits and r.got is None


class Handle:
    """State of one key, held in memory."""

    def __init__(self):
        self.map, self.value, self.timers = {}, [], set()

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Handle()

    def registerTimer(self, at):
        self.timers.add(at)

    def updateValue(self, key, value):
        self.map[key] = value

    def exists(self):
        return bool(self.value)

    def update(self, value):
        self.value = value


def test_waiting_rows_are_one_value_of_state():
    frames = {
        processors.AnchoredWindows(8000, 1000, 1, 0.5): {"at": [2500, 1, 999], "event_id": ["b", "", "é"], "is_error": [True, False, True]},
        processors.Cooldown(8000, 1000, {"id": "STRING", "value": "DOUBLE"}): {"at": [1, 2500], "id": ["x", "y"], "value": [0.5, None]},
    }
    for processor, columns in frames.items():
        handle, rows = Handle(), pd.DataFrame(columns)
        processor.init(handle)
        list(processor.handleInputRows(("k",), iter([rows]), None))
        assert sorted(handle.map) == [(0, 0), (2, 0)] and handle.timers == {1000, 3000}
        assert all(len(v) == 1 and isinstance(v[0], bytes) for v in handle.map.values())
        back = pd.concat([processors.unpacked(v[0]) for _, v in sorted(handle.map.items())], ignore_index=True)
        want = rows.sort_values("at", kind="stable", ignore_index=True)
        pd.testing.assert_frame_equal(back.sort_values("at", ignore_index=True), want, check_dtype=False)


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_packed_files_are_dealt_out_before_they_are_decoded(spark, tmp_path):
    path = str(tmp_path / "archive")
    cold_store.write_archive(spark.createDataFrame([(x,) for x in LINES[:4]], "value STRING"), path, NOW)
    scanned = cold_store.scan_archive(spark, path)
    assert sorted(r.event_id for r in scanned.collect()) == ["1", "2"]
    before, _, after = logical(scanned).partition("RebalancePartitions")
    assert "parseJson" in before and "parseJson" not in after and "Relation [value" in after


def test_reconciliation_parses_each_line_once_in_even_tasks(spark):
    plan_text = logical(QUERIES["reconcile_tiers"](spark, SF_DIR))
    assert plan_text.count("RebalancePartitions") == 1 and plan_text.count("parseJson") == 1


def test_events_of_one_row_group_become_lines_in_even_tasks(spark):
    lines = tables.logs_raw(spark, SF_DIR)
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == tables.logs_wire(spark, SF_DIR).count() and max(sizes) < sum(sizes) / 4


def test_good_lines_are_parsed_without_a_failing_path_or_a_second_object(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value STRING")
    for df in (cold_store.routed(lines, NOW), fj.decode_events(lines)):
        taken = [line for line in plan(df).splitlines() if "$[" in line]
        assert "$[1]" not in "".join(taken) and "$[2]" not in "".join(taken)
        assert not [x for x in taken if "$[0], VariantType" in x and "_whole" not in x]


def test_a_line_that_goes_on_with_its_own_hash_is_refused(spark):
    lines = spark.createDataFrame([(x,) for x in LINES if x and x[0] == "{"], "value STRING")
    more = [F.concat("value", F.lit(s), F.xxhash64("value")) for s in (",", "],[", " ")]
    for value in [*more, F.concat("value", F.lit(",1"))]:
        errors = {r.decode_error for r in fj.decode_events(lines.select(value.alias("value"))).collect()}
        assert errors == {"unmarshal: invalid JSON"}
