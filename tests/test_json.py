import json
from datetime import datetime

from pyspark.sql import functions as F

from logweir.functions import json as fj
from logweir.operators.normalize import accepted, dead_letters, normalize
from logweir.schema import DEAD_LETTER_COLUMNS, LOG_COLUMNS

NOW = datetime(2024, 1, 31)

GOOD = {
    '{"event_id":"1","timestamp":"2024-01-01T00:00:00Z","service":"a","message":"m"}': {"service": "a"},
    '{"service":"a","service":"b"}': {"service": "b"},
    '{"SERVICE":"c"}': {"service": "c"},
    '{"ſervice":"d"}': {"service": "d"},
    "null": {"service": "", "timestamp": None},
    " {} ": {"service": ""},
    '{"service":null,"timestamp":null,"attributes":null}': {"service": "", "timestamp": None},
    '{"service":"a","extra":[1,{"b":2}]}': {"service": "a"},
    '{"timestamp":"0001-01-01T00:00:00Z"}': {"timestamp": None},
    '{"timestamp":"2024-01-01T02:00:00.1234567+02:00"}': {
        "timestamp": datetime(2024, 1, 1, 0, 0, 0, 123456)
    },
    '{"service":"x\\u0041\\n"}': {"service": "xA\n"},
}
BAD = {
    "{bad": "invalid JSON",
    "": "invalid JSON",
    '{"service":"a"} x': "invalid JSON",
    '{"service":"a"},{}': "invalid JSON",
    '{"service":"a"}],[': "invalid JSON",
    '{"service":"a"},1],[2': "invalid JSON",
    "{'service':'a'}": "invalid JSON",
    '{"a":NaN}': "invalid JSON",
    '{"a":01}': "invalid JSON",
    "[]": "not an object",
    "5": "not an object",
    '"s"': "not an object",
    '{"event_id":1}': "event_id is not a string",
    '{"message":{"a":1}}': "message is not a string",
    '{"region":true}': "region is not a string",
    '{"timestamp":"2024-01-01 00:00:00"}': "timestamp is not RFC 3339",
    '{"timestamp":""}': "timestamp is not RFC 3339",
    '{"timestamp":1704067200}': "timestamp is not RFC 3339",
    '{"timestamp":"2024-02-30T00:00:00Z"}': "timestamp is not RFC 3339",
    '{"attributes":[1]}': "attributes is not an object",
    '{"attributes":"x"}': "attributes is not an object",
}


def lines(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, value STRING")


def test_good_lines(spark):
    rows = sorted(fj.decode_events(lines(spark, GOOD)).drop("attributes").collect())
    for row, (line, fields) in zip(rows, GOOD.items(), strict=True):
        assert row.decode_error is None, line
        for name, value in fields.items():
            assert row[name] == value, line


def test_bad_lines(spark):
    decoded = fj.decode_events(lines(spark, BAD))
    errors = [r.decode_error for r in sorted(decoded.drop("attributes").collect())]
    assert errors == [f"unmarshal: {e}" for e in BAD.values()]
    assert accepted(decoded).count() == 0
    dead = dead_letters(decoded, NOW)
    assert dead.columns == DEAD_LETTER_COLUMNS
    assert sorted(r.raw for r in dead.collect()) == sorted(BAD)
    assert {(r.event_id, r.component, r.failed_at) for r in dead.collect()} == {
        ("", "processing-worker", NOW)
    }


def test_filters_do_not_repeat_the_parse(spark):
    plan = accepted(fj.decode_events(lines(spark, GOOD)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_attribute_redaction(spark):
    raw = {
        "Db_Password": "x", "tokens_used": 12, "nested": {"password": "kept"}, "ok": [1, 2],
        "SSN": None, "aPiKeY": {"a": 1}, "plain": "secret",
    }
    df = lines(spark, [json.dumps(raw), "{}", "null", None, '{"b":null,"a":[1.5,{"z":1,"y":"é\\n"}]}'])
    got = df.select("i", fj.redacted_text(F.try_parse_json("value")).alias("a"))
    slow = df.select("i", fj.attributes_text(fj.redact_attributes(F.try_parse_json("value"))).alias("a"))
    assert sorted(got.filter("i != 2").collect()) == sorted(slow.filter("i != 2").collect())
    texts = [r.a for r in sorted(got.collect())]
    assert json.loads(texts[0]) == {
        "Db_Password": "[REDACTED]", "tokens_used": "[REDACTED]", "nested": {"password": "kept"},
        "ok": [1, 2], "SSN": "[REDACTED]", "aPiKeY": "[REDACTED]", "plain": "secret",
    }
    assert texts[1:4] == ["{}", "null", "null"]
    assert list(json.loads(texts[0])) == sorted(json.loads(texts[0]))


def test_attributes_from_text(spark):
    df = lines(spark, ['{"a":1}', '"{\\"a\\":2}"', "null", "{bad"])
    got = df.select("i", F.try_variant_get(fj.attributes_variant(F.col("value")), "$.a", "int").alias("a"))
    assert [r.a for r in sorted(got.collect())] == [1, 2, None, None]


def test_upsert(spark):
    df = lines(spark, ['{"a":1,"source":7}', "null", None])
    upserted = fj.upsert_attributes(F.try_parse_json("value"), {"source": "s", "a.b": "c"})
    got = [json.loads(r.t) for r in df.select("i", F.to_json(upserted).alias("t")).orderBy("i").collect()]
    assert got == [{"a": 1, "source": "s", "a.b": "c"}, {"source": "s", "a.b": "c"}, {"source": "s", "a.b": "c"}]


def test_normalize_event(spark):
    line = json.dumps(
        {
            "event_id": "1", "service": "a", "severity": " err ", "message": "token=abc done",
            "attributes": {"api_key": "k", "n": 1}, "timestamp": "2024-01-01T00:00:00.123999Z",
        }
    )
    row = normalize(accepted(fj.decode_events(lines(spark, [line]))), NOW).collect()[0]
    assert row.asDict() == {
        "event_id": "1", "timestamp": datetime(2024, 1, 1, 0, 0, 0, 123000), "service": "a",
        "severity": "ERROR", "message": "[REDACTED] done",
        "attributes": '{"api_key":"[REDACTED]","n":1}', "trace_id": "", "source": "", "region": "", "version": "",
    }
    empty = normalize(accepted(fj.decode_events(lines(spark, ["null"]))), NOW).collect()[0]
    assert (empty.severity, empty.timestamp, empty.attributes) == ("INFO", NOW, "null")


def test_event_json_round_trip(spark):
    line = json.dumps(
        {
            "event_id": "1", "timestamp": "2024-01-01T00:00:00.500000Z", "service": "a", "severity": "INFO",
            "message": 'quote " and \\ slash', "attributes": {"a.b": [1, None]}, "source": "s",
        }
    )
    decoded = accepted(fj.decode_events(lines(spark, [line]))).select(*LOG_COLUMNS)
    text = decoded.select(fj.event_json(decoded).alias("t")).collect()[0].t
    assert json.loads(text) == json.loads(line)
    bare = accepted(fj.decode_events(lines(spark, ['{"event_id":"2"}']))).select(*LOG_COLUMNS)
    text = bare.select(fj.event_json(bare).alias("t")).collect()[0].t
    assert set(json.loads(text)) <= {"event_id", "timestamp", "service", "severity", "message"}
