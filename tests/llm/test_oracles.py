import pytest
from compare import difference, duck
from support import SF_DIR, awkward, awkward_rows  # noqa: F401

import __spark_entry__ as contract
from logweir.llm.oracles import ORACLES
from logweir.llm.queries import QUERIES


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name]) is None


def test_the_frequency_of_lines_decides_on_the_test_tables(spark):
    con = duck("/root/testdata/sf0.01")
    dropped = con.execute(f"SELECT count(*) FILTER (n_dropped > 0) FROM ({ORACLES['op2_line_dedup']})").fetchone()[0]
    lines, depleted = con.execute(
        f"SELECT count(*) FILTER (n_left_words < n_words), count(*) FILTER (kept <> NOT base_failed) FROM ({ORACLES['op10_quality_rules']})"
    ).fetchone()
    assert dropped > 100 and lines > 5 and depleted > 0


@pytest.mark.parametrize("name", ["op2_line_dedup", "op8_fingerprints", "op10_quality_rules"])
def test_awkward_rows_equal_the_oracle(spark, awkward, name, tmp_path):
    folder = tmp_path / "t"
    awkward.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(str(folder / "parts"))
    (file,) = (folder / "parts").glob("*.parquet")
    file.rename(folder / "documents.parquet")
    assert difference(QUERIES[name](spark, str(folder)), duck(str(folder)), ORACLES[name]) is None
