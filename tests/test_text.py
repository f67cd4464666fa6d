from pyspark.sql import functions as F

from logweir.functions import text
from logweir.functions.times import parse_timestamp, timestamp_error


def apply(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i INT, v STRING").select("i", fn(F.col("v")).alias("r"))
    return [r.r for r in sorted(df.collect())]


def test_severity(spark):
    cases = {
        "emerg": "FATAL", "EMERGENCY": "FATAL", "critical": "FATAL", "fatal": "FATAL",
        "Err": "ERROR", " error\t": "ERROR", " warn ": "WARNING", "Warning": "WARNING",
        "information": "INFO", "info": "INFO", "": "INFO", "   ": "INFO", " err ": "ERROR",
        "TRACE": "DEBUG", "debug": "DEBUG", "notice": "NOTICE", "crit": "CRIT",
    }
    assert apply(spark, text.normalize_severity, list(cases)) == list(cases.values())


def test_redaction(spark):
    cases = {
        "password: hunter2": "[REDACTED]",
        "API_KEY=abc rest": "[REDACTED] rest",
        "mail a@b.co now": "mail [REDACTED] now",
        "a@b.c": "a@b.c",
        "x@y.c|m": "[REDACTED]",
        "pay 1234 5678 9012 3456 ok": "pay [REDACTED] ok",
        "1234-5678-9012-3456": "[REDACTED]",
        "1234567890123456": "[REDACTED]",
        "12345678901234567": "12345678901234567",
        "é1234567890123456é": "é[REDACTED]é",
        "authorization: Bearer x": "[REDACTED] x",
        "my tokens here": "my tokens here",
        "toKen=a": "[REDACTED]",
        "paſsword=a": "[REDACTED]",
        "secret\n=\tv w": "[REDACTED] w",
        "secret =v": "secret =v",
        "token=a@b.co": "[REDACTED]",
    }
    assert apply(spark, text.redact_secrets, list(cases)) == list(cases.values())


def test_template(spark):
    cases = {
        "id 123e4567-e89b-12d3-a456-426614174000 gone": "id <UUID> gone",
        "from 10.0.0.255 port 8080": "from <IP> port <N>",
        "blob deadbeef01 short abc": "blob <HEX> short abc",
        "12345678": "<HEX>",
        "x_9 42 9x": "x_9 <N> 9x",
        "é7é": "é<N>é",
        "4111-1111-1111-1234": "<N>-<N>-<N>-<N>",
        "DEADBEEF01": "DEADBEEF01",
    }
    assert apply(spark, text.message_template, list(cases)) == list(cases.values())


def test_previews(spark):
    assert apply(spark, text.message_preview, ["a" * 120, "a" * 121]) == ["a" * 120, "a" * 120 + "..."]
    assert apply(spark, text.trace_preview, ["", None, "abc", "0123456789abcdef"]) == [
        "-", "-", "abc...", "0123456789ab...",
    ]


def test_partition_key(spark):
    rows = [("a", "s"), ("a", ""), ("a", None)]
    df = spark.createDataFrame(rows, "service STRING, source STRING")
    got = df.select(text.partition_key(F.col("service"), F.col("source"))).collect()
    assert [r[0] for r in got] == ["a:s", "a", "a"]


def test_fixed2_rounds_the_binary_value(spark):
    values = [e / t * 100 for t in range(1, 200) for e in range(0, t + 1, 7)]
    values += [15.625, 3.125, 6.055, 0.125, 0.375, 100.0, 0.005, 99.995]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for row in df.select("v", text.fixed2(F.col("v")).alias("t")).collect():
        assert row.t == f"{row.v:.2f}"


def test_parse_timestamp(spark):
    good = ["2024-01-02 03:04:05.678", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456+02:00"]
    bad = ["2024-01-02 03:04:05", "2024-01-02", "", "2024-13-02T03:04:05Z", "2024-01-02T03:04:05"]
    got = apply(spark, parse_timestamp, good + bad)
    assert [str(v) for v in got[:3]] == [
        "2024-01-02 03:04:05.678000", "2024-01-02 03:04:05", "2024-01-02 01:04:05.123456",
    ]
    assert got[3:] == [None] * len(bad)


def test_timestamp_errors_tell_why(spark):
    texts = ["2024-01-02 03:04:05.678", "2024-01-02T03:04:05Z", None, "2024-13-02T03:04:05Z", 'a "b"', ""]
    got = apply(spark, timestamp_error, texts)
    assert got[:3] == [None] * 3
    assert got[3] == 'parsing time "2024-13-02T03:04:05Z": neither a hot-table time nor RFC 3339'
    assert got[4].startswith('parsing time "a \\"b\\"": ') and got[5].startswith('parsing time "": ')
