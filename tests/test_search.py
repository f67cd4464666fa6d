from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logweir.operators import search
from logweir.params import Retention, SearchRequest, page_count
from logweir.schema import LOG_COLUMNS

AS_OF = datetime(2024, 1, 31)
CUTOFF = AS_OF - timedelta(days=7)


def logs(spark, rows):
    """Rows of (event_id, timestamp, service, severity, message)."""
    df = spark.createDataFrame(
        rows, "event_id STRING, timestamp TIMESTAMP_NTZ, service STRING, severity STRING, message STRING"
    )
    for name in LOG_COLUMNS[5:]:
        df = df.withColumn(name, F.lit(""))
    return df


def many(spark, n=500, step=timedelta(minutes=43)):
    return logs(
        spark,
        [(f"{i:05d}", AS_OF - step * (i // 2), f"s{i % 3}", "INFO", f"message {i}") for i in range(n)],
    )


def ids(df):
    return [r.event_id for r in df.collect()]


def test_aware_times_are_utc():
    zone = timezone(timedelta(hours=2))
    req = search.SearchRequest(start=datetime(2024, 1, 1, 12, tzinfo=zone), limit=20_000).resolved(datetime(2024, 1, 2))
    assert req.start == datetime(2024, 1, 1, 10) and req.limit == 10_000


def test_request_defaults():
    req = SearchRequest().resolved(AS_OF)
    assert (req.start, req.end, req.limit) == (AS_OF - timedelta(days=1), AS_OF, 100)
    assert SearchRequest(limit=20_000).resolved(AS_OF).limit == 10_000
    assert SearchRequest(limit=-3).resolved(AS_OF).limit == 100
    with pytest.raises(ValueError):
        SearchRequest(offset=-1).resolved(AS_OF)
    assert SearchRequest.relative("7d", AS_OF).start == CUTOFF
    assert SearchRequest.relative("2y", AS_OF).start == AS_OF - timedelta(days=1)
    assert SearchRequest(limit=50, offset=120).resolved(AS_OF).page == 2
    assert [page_count(n, 50) for n in (0, 1, 50, 51)] == [0, 1, 1, 2]


def test_route():
    def tier(start, end):
        return search.route(SearchRequest(start=start, end=end), AS_OF)

    second = timedelta(seconds=1)
    assert tier(CUTOFF - 9 * second, CUTOFF - second) == "cold"
    assert tier(CUTOFF - 9 * second, CUTOFF) == "merged"
    assert tier(CUTOFF, AS_OF) == "merged"
    assert tier(CUTOFF + second, AS_OF) == "hot"
    assert Retention(route_days=1).cutoff(AS_OF) == AS_OF - timedelta(days=1)


def test_filters(spark):
    rows = [
        ("1", AS_OF, "a", "ERROR", "It TIMED out"),
        ("2", AS_OF, "a", "error", "ÉTÉ timed"),
        ("3", AS_OF, "O'Brien", "ERROR", "x' OR '1'='1"),
        ("4", AS_OF + timedelta(milliseconds=1), "a", "ERROR", "late"),
    ]
    df = logs(spark, rows)
    base = SearchRequest(start=AS_OF, end=AS_OF, limit=10)
    assert sorted(ids(search.filter_hot(df, base))) == ["1", "2", "3"]
    assert ids(search.filter_hot(df, replace(base, severity="error"))) == ["2"]
    assert sorted(ids(search.filter_cold(df, replace(base, severity="eRRor")))) == ["1", "2", "3"]
    assert sorted(ids(search.filter_hot(df, replace(base, search="timed")))) == ["1", "2"]
    assert ids(search.filter_hot(df, replace(base, search="été"))) == ["2"]
    assert ids(search.filter_hot(df, replace(base, service="O'Brien"))) == ["3"]
    assert ids(search.filter_hot(df, replace(base, search="' OR '"))) == ["3"]
    wide = replace(base, end=AS_OF + timedelta(microseconds=999))
    assert sorted(ids(search.filter_hot(df, wide))) == ["1", "2", "3"]


def test_pages_cover_the_result_once(spark):
    df = many(spark)
    req = SearchRequest(start=datetime(2020, 1, 1), end=AS_OF, limit=70)
    want = [r.event_id for r in df.orderBy(F.desc("timestamp"), F.desc("event_id")).collect()]
    for deep in (search.DEEP_PAGE, 0):
        got = []
        for offset in range(0, 560, 70):
            got += ids(search.page_of(df, replace(req, offset=offset), deep_page=deep))
        assert got == want
    assert ids(search.page_of(df, replace(req, offset=10_000))) == []
    assert ids(search.page_of(df, replace(req, offset=10_000), deep_page=0)) == []


def test_merged_page_equals_the_page_over_everything(spark):
    df = many(spark)
    calls = []

    def tier(name, low, high):
        def read(req):
            calls.append((name, req.start, req.end))
            return df.filter(F.col("timestamp").between(F.lit(low), F.lit(high)))
        return read

    # Both tiers hold the event at the cutoff; it must count once.
    hot = tier("hot", CUTOFF - timedelta(days=3), AS_OF)
    cold = tier("cold", datetime(2020, 1, 1), AS_OF)
    req = SearchRequest(start=datetime(2024, 1, 18), end=AS_OF, limit=60, offset=440)
    everything = search.filter_hot(df, req)
    for deep in (search.DEEP_PAGE, 100):
        found = search.search(hot, cold, req, AS_OF, deep_page=deep)
        assert found.source == "merged" and found.degraded == ()
        assert ids(found.page) == ids(search.page_of(everything, req))
        assert found.total.first().total == everything.count()
    assert calls[0] == ("hot", CUTOFF, AS_OF) and calls[1] == ("cold", req.start, CUTOFF)


def test_lost_tier(spark):
    df = many(spark)

    def lost(req):
        return spark.read.parquet("/nonexistent/table")

    req = SearchRequest(start=datetime(2024, 1, 10), end=AS_OF, limit=10_000)
    found = search.search(lambda r: df, lost, req, AS_OF)
    assert found.degraded == ("cold",)
    assert found.page.count() == df.filter(F.col("timestamp") >= F.lit(CUTOFF)).count()
    with pytest.raises(AnalysisException):
        search.search(lost, lost, req, AS_OF)
    with pytest.raises(AnalysisException):
        search.search(lambda r: df, lost, replace(req, end=CUTOFF - timedelta(days=1)), AS_OF)


def test_scan_budget(spark):
    df = many(spark)
    assert search.within_scan_budget(df, 500).count() == 500
    assert search.within_scan_budget(df, 10**9).count() == 500
    with pytest.raises(search.ScanBudgetExceeded):
        search.within_scan_budget(df, 499)


def test_page_is_a_bounded_top_k(spark):
    plan = search.page_of(many(spark), SearchRequest(limit=10, offset=5))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=15" in plan
