import json
from datetime import datetime, timedelta

from logweir.operators import ingest

NOW = datetime(2024, 1, 31)


def requests(spark, bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "request INT, body STRING")


def event(**fields):
    return {"event_id": "1", "service": "a", "severity": "INFO", "message": "m", **fields}


def test_requests(spark):
    bodies = [
        json.dumps({"events": [event(event_id=str(i)) for i in (3, 1, 2)]}),
        json.dumps({"EVENTS": [event(), event(service=""), event(message="")]}),
        json.dumps({"events": [event(), event(service=7)]}),
        json.dumps({"events": [event(), event(timestamp="yesterday")]}),
        json.dumps({"events": [event(), [1]]}),
        json.dumps({"events": [event(attributes=[1])]}),
        '{"events": []}',
        "{}",
        '{"events": 5}',
        "[1]",
        "{bad",
        json.dumps({"events": [event(), None]}),
    ]
    rows = ingest.explode_requests(requests(spark, bodies))
    order = [(r.pos, r.event_id) for r in rows.filter("request = 0").drop("attributes").orderBy("pos").collect()]
    assert order == [(0, "3"), (1, "1"), (2, "2")]

    refused = {r.request: r.request_error for r in rows.filter("request_error IS NOT NULL").drop("attributes").collect()}
    assert set(refused) == {2, 3, 4, 5, 8, 9, 10}
    assert refused[2] == "unmarshal: malformed event"
    assert rows.filter("request IN (2, 3, 4, 5, 8, 9, 10) AND pos IS NOT NULL").count() == 0

    checked = ingest.validate(rows)
    outcome = {r.request: (r.accepted, r.failed) for r in ingest.request_outcome(checked, "request").collect()}
    assert outcome == {
        0: (3, 0), 1: (1, 2), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0), 7: (0, 0),
        8: (0, 0), 9: (0, 0), 10: (0, 0), 11: (1, 1),
    }
    by_service = {(r.service, r.status): r.events for r in ingest.service_outcome(checked).collect()}
    assert by_service == {("a", "accepted"): 5, ("unknown", "rejected"): 3}


def test_defaults(spark):
    rows = ingest.explode_requests(
        requests(spark, [json.dumps({"events": [event(event_id=""), event(event_id=""), event(message="n", event_id="")]})])
    )
    filled = ingest.with_defaults(rows, NOW).drop("attributes").orderBy("pos").collect()
    assert {r.timestamp for r in filled} == {NOW}
    ids = [r.event_id for r in filled]
    assert all(ids) and ids[0] == ids[1] != ids[2]


def test_blank_is_not_empty(spark):
    rows = spark.createDataFrame([(" ", "m"), ("", "m"), (None, "m"), ("a", " ")], "service STRING, message STRING")
    assert [r.valid for r in ingest.validate(rows).collect()] == [True, False, False, True]


def test_refused_requests_are_told_from_empty_ones(spark):
    rows = ingest.explode_requests(requests(spark, ["{bad", '{"events":[]}']))
    name = [c for c in rows.columns if c.startswith("request")][0]
    out = ingest.request_outcome(ingest.validate(rows), name).collect()
    assert sorted((r.accepted, r.failed, r.refused or "") for r in out) == [(0, 0, ""), (0, 0, "unmarshal: not a request")]


def test_keyed(spark):
    rows = ingest.with_defaults(ingest.explode_requests(requests(spark, [json.dumps({"events": [event(source="s")]})])), NOW)
    got = ingest.keyed(rows).collect()[0]
    assert got.key == "a:s" and json.loads(got.value)["source"] == "s"


def brute_force_shed(rows, quota):
    used, out = {}, {}
    for rid, arrived, size in sorted(rows, key=lambda r: (r[1], r[0])):
        second = arrived.replace(microsecond=0)
        before = used.get(second, 0)
        out[rid] = before > quota
        if not out[rid]:
            used[second] = before + size
    return out


def test_quota(spark):
    start = datetime(2024, 1, 1)
    rows = [
        (i, start + timedelta(milliseconds=(i * 37) % 3000), 1 + i % 7) for i in range(400)
    ] + [(1000 + i, start, 3) for i in range(30)]
    df = spark.createDataFrame(rows, "request_id INT, arrived TIMESTAMP_NTZ, size INT")
    for quota in (0, 50, 100, 10_000):
        got = {r.request_id: r.refused for r in ingest.shed_over_quota(df, quota).collect()}
        assert got == brute_force_shed(rows, quota)
