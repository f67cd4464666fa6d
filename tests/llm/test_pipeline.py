from collections import Counter, defaultdict

from support import SF_DIR

import corpus_pipeline
from logweir.llm.byte_bpe import Codec, RANKS
from logweir.llm.quality_rules import boilerplate
from test_operators import LOWER, WORD, brute_repeats


def line_key(line):
    return " ".join(WORD.findall(line.lower()))


def holders(rows):
    """(source, line) -> texts that hold the line, and source -> texts."""
    held, texts = defaultdict(set), defaultdict(set)
    for r in rows:
        texts[r.source].add(r.text)
        for line in (r.text or "").split("\n"):
            if WORD.search(line):
                held[r.source, line_key(line)].add(r.text)
    return held, texts


def brute_rules(rows):
    held, _ = holders(rows)
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        lost = sum(len(WORD.findall(x)) for x in (r.text or "").split("\n") if len(held[r.source, line_key(x)]) > 10)
        if n >= 20 and 100 * brute_repeats(r.text) <= 30 * n and n - lost >= 20 and n - lost >= 0.3 * n:
            yield r


def brute_lines(rows):
    held, texts = holders(rows)
    for r in rows:
        own = r.text.split("\n")
        drop = [WORD.search(x) and 3 <= len(held[r.source, line_key(x)]) > 0.02 * len(texts[r.source]) for x in own]
        yield (r.doc_id, "\n".join(x for x, d in zip(own, drop) if not d) if any(drop) else r.text)


def shingles(text):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    """The least id of each component of documents linked by 80 % of their shingles, found by an inverted index."""
    rows = list(rows)
    sets = [shingles(t) for _, t in rows]
    index = defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(sets):
        met = Counter(j for s in own for j in index[s])
        for j, shared in met.items():
            if 100 * shared >= 80 * (len(own) + len(sets[j]) - shared):
                root[find(i)] = find(j)
        for s in own:
            index[s].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return set(least.values())


def test_run_against_brute_force_at_each_stage(spark, tmp_path, monkeypatch):
    sf_dir = "/root/testdata/sf0.01"
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["quality_rules", "line_dedup", "jaccard_join", "mixing", "byte_bpe"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    last = corpus_pipeline.run(spark, sf_dir)
    (folder,) = tmp_path.iterdir()
    seen = [docs, *(spark.read.parquet(str(folder / f"{k}-{n}")) for k, n in enumerate(names))]
    assert all(d.columns == docs.columns for d in seen[:-1])
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = [d.collect() for d in seen]
    assert sorted(map(tuple, rows[5])) == sorted(map(tuple, last.collect()))
    good = list(brute_rules(rows[0]))
    base = sum(len(WORD.findall(r.text or "")) >= 20 and 100 * brute_repeats(r.text) <= 30 * len(WORD.findall(r.text)) for r in rows[0])
    assert len(good) < base  # depleted documents went
    assert sorted((r.doc_id, r.text) for r in rows[1]) == sorted((r.doc_id, r.text) for r in good)
    assert sorted((r.doc_id, r.text) for r in rows[2]) == sorted(brute_lines(rows[1]))
    assert {(r.doc_id, r.text) for r in rows[1]} != {(r.doc_id, r.text) for r in rows[2]}  # lines went
    left = [(r.doc_id, r.text) for r in rows[2]]
    assert {r.doc_id for r in rows[3]} == brute_groups((i, t) for i, t in left if WORD.search(t)) | {i for i, t in left if not WORD.search(t)}
    texts = {r.doc_id: r.text for r in rows[3]}
    assert all(set(WORD.findall(r.text)) <= set(WORD.findall(texts[r.doc_id])) for r in rows[4])
    taken, there = (sum(len(WORD.findall(r.text)) for r in x) for x in (rows[4], rows[3]))
    assert abs(taken - there) <= 0.05 * there
    import public_tokenizers

    codec = Codec(public_tokenizers.path(RANKS))
    assert sorted((r.doc_id, r.n_tokens) for r in rows[5]) == sorted((r.doc_id, len(codec.encode(r.text))) for r in rows[4])


def test_near_copies_go_by_five_words_and_four_fifths(spark):
    rows = [(1, " ".join(f"u{i}" for i in range(40)), "a"), (2, " ".join(f"u{i}" for i in range(33)), "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, SF_DIR).collect()] == [1]


def test_rules_remove_lines_and_reject_depleted_documents(spark):
    stage = dict(corpus_pipeline.STAGES)["quality_rules"]
    line = " ".join(f"menu{i}" for i in range(40))
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    # 11 of 1,011 documents hold the line (1 %): those with little else go. On 10 documents of another source it stays.
    rows = [(i, f"{line}\n{own(i, 50 if i < 5 else 3)}", "a") for i in range(11)] + [(100 + i, own(i, 30), "a") for i in range(1000)]
    rows += [(2000 + i, f"{line}\nown{i}", "b") for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    assert {r.doc_id for r in stage(spark, docs, SF_DIR).collect()} == {i for i, *_ in rows} - set(range(5, 11))


def test_rules_remove_lines_of_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert boilerplate(docs, 10).count() == 11


def test_line_dedup_acts_on_small_sources(spark):
    rows = [(i, f"menu top\nown {i}", "a") for i in range(19)] + [(50 + i, ("menu top\n" if i < 3 else "") + f"other {i}", "b") for i in range(8)]
    rows += [(70 + i, ("menu top\n" if i < 2 else "") + f"more {i}", "c") for i in range(8)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    out = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SF_DIR).collect()}
    assert out == {i: t if s == "c" else t.removeprefix("menu top\n") for i, t, s in rows}
