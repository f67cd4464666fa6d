"""Rows that operators stumble over; the fixtures are imported by the test modules."""

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def make(spark, rows, extra=False):
    """Documents of (doc_id, text, source); extra columns bear names that operators use inside."""
    full = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
    docs = spark.createDataFrame(full, COLUMNS)
    if extra:
        for name in ("host", "content", "kept", "n_words", "size", "s", "at", "row", "key", "pos", "words", "label", "score"):
            docs = docs.selectExpr("*", f"concat('x', doc_id) AS {name}")
    return docs


@pytest.fixture(scope="session")
def awkward_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    plain = [(i, " ".join(rng.choice(words) for _ in range(40)), f"src{i % 3}") for i in range(30)]
    return plain + [
        (None, None, None), (100, None, "src0"), (101, "", "src0"), (102, " \t\n\x0b ", None), (103, "one", "src1"),
        (104, long, "src1"), (105, long + " end", "src1"), (106, "x" * 50_000, "src2"), (107, "é 漢字 😀 ẞ ſ a", "src2"),
        (108, "Same Text here now and then", "src0"), (109, "same text HERE now and then", "src1"),
        (3, plain[3][1], "src0"), (3, plain[3][1], "src0"), (110, plain[4][1], None), (None, plain[5][1], "src2"),
    ]


@pytest.fixture()
def awkward(spark, awkward_rows):
    return make(spark, awkward_rows, extra=True)


@pytest.fixture()
def empty(spark):
    return make(spark, [], extra=True)
