import gzip
import hashlib
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweir.llm import warc

A, B, SMALL = "<p>" + "long text " * 30 + "é漢</p>", "x" * 100, "y" * 99


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def pages(spark, rows):
    docs = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    return docs.selectExpr("*", "'z' AS payload", "'z' AS digest", "1 AS n", "'z' AS record_type", "0 AS salt", "'z' AS key")


AWKWARD = [
    (5, "http://a/5", A), (3, "http://a/3", A), (9, None, A), (3, "http://a/3", A), (None, "http://n", A),
    (7, "http://b\r\nX: y/ 7", B), (8, "", B), (8, None, B), (1, "u", SMALL), (2, "u", SMALL), (2, "u", SMALL),
    (4, "e", ""), (6, None, None), (None, None, None), (None, None, "null ids only " * 20), (None, None, "null ids only " * 20),
    (10, "big", "ab" * 500_000), (11, "nul", "\x00\r\n\r\nWARC/1.1\r\n" * 20),
]


def expected(rows):
    least, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for page, _, html in order:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        if len(data) >= 100 and digest in least:
            out.append((page, len(data), digest, "revisit", least[digest]))
        else:
            least.setdefault(digest, page)
            out.append((page, len(data), digest, "response", None))
    return Counter(out)


@pytest.mark.parametrize("rows", [AWKWARD, [], [(i % 3, "same", A) for i in range(40)]])
def test_archive_round_trip_equals_brute_force(spark, folder, rows, monkeypatch):
    monkeypatch.setattr(warc, "PART", 4)  # copies of one row in several parts
    out = warc.archived_pages(pages(spark, rows), folder)
    assert Counter(tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(rows)


def test_payloads_and_references_come_back(spark, folder):
    warc.write_pages(pages(spark, AWKWARD), folder)
    rows = spark.read.format("warc").load(folder).collect()
    texts = Counter((h or "").encode() for _, _, h in AWKWARD)
    found = {r.record_id: r for r in rows}
    assert len(found) == len(AWKWARD)
    back = Counter(bytes(r.payload) if r.record_type == "response" else bytes(found[r.refers_to_id].payload) for r in rows)
    assert back == texts
    assert {r.target_uri for r in rows if r.page_id == 7} == {"http://b%0D%0AX:%20y/%207"}


def test_predicates_are_pushed_and_payloads_skipped(spark, folder, monkeypatch):
    warc.write_pages(pages(spark, AWKWARD), folder)
    load = lambda **o: spark.read.format("warc").options(**o).load(folder)
    plan = load().where("record_type = 'revisit' AND payload_bytes > 100")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    everything = load().collect()
    tests = {
        "record_type = 'revisit' AND payload_bytes > 100": lambda r: r.record_type == "revisit" and r.payload_bytes > 100,
        "page_id IN (1, 2) OR page_id IS NULL": lambda r: r.page_id in (1, 2, None),
        "page_id IS NULL": lambda r: r.page_id is None,
        "page_id <> 3": lambda r: r.page_id is not None and r.page_id != 3,
        "target_uri LIKE 'http://a/%'": lambda r: (r.target_uri or "").startswith("http://a/"),
        "refers_to <=> 3": lambda r: r.refers_to == 3,
        "payload IS NULL": lambda r: r.payload is None,
    }
    for sql, want in tests.items():
        assert sorted(r.record_id for r in load().where(sql).collect()) == sorted(r.record_id for r in everything if want(r)), sql
    heads = load(payload="false").collect()
    assert len(heads) == len(AWKWARD) and all(r.payload is None for r in heads)
    # Blocks of unwanted records are not decoded.
    reader = warc.WarcReader({"path": folder}, ["page_id", "payload"])
    list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    decoded, plain = [], warc._payload
    monkeypatch.setattr(warc, "_payload", lambda file, n, kind: decoded.append(n) or plain(file, n, kind))
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert len(got) == len(decoded) == sum(r.record_type == "revisit" for r in everything)


def test_only_committed_files_are_read(spark, folder, tmp_path):
    rows = pages(spark, [(1, "u", A), (2, "v", B)]).repartition(2)
    warc.write_pages(rows, folder)
    warc.write_pages(rows, folder)
    (tmp_path / folder / "part-left-behind.warc").write_bytes(b"WARC/1.1\r\nContent-Le")
    assert spark.read.format("warc").load(folder).count() == 4
    for name in (tmp_path / folder).glob("part-*.warc"):
        if name.name != "part-left-behind.warc":
            name.unlink()
            break
    with pytest.raises(Exception, match="missing"):
        spark.read.format("warc").load(folder).count()


def test_files_roll_and_plain_and_gzip_archives_of_others_are_read(spark, folder, tmp_path):
    warc.use_warc(spark)
    rows = [{"record_type": t, "record_id": f"<{i}>", "payload": b"%d" % i * 300, "page_id": i} for i, t in enumerate(["warcinfo", "response", "metadata"])]
    data = [warc.record_bytes(r) for r in rows]
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc").write_bytes(b"".join(data))
    (other / "b.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    read = spark.read.format("warc").load(str(other)).where("page_id > 0").collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in read) == {(1, b"1" * 300): 2, (2, b"2" * 300): 2}
    warc.page_records(pages(spark, AWKWARD), "2024-01-01T00:00:00Z").coalesce(1).write.format("warc").option("max_bytes", 500).mode("append").save(folder)
    assert len(list((tmp_path / folder).glob("*.warc"))) > 3 and spark.read.format("warc").load(folder).count() == len(AWKWARD)
    (other / "a.warc").write_bytes(b"".join(data)[:-400])
    with pytest.raises(Exception, match="early"):
        spark.read.format("warc").load(str(other)).agg(F.count("payload")).collect()
