import base64
import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from support import SF_DIR, awkward, awkward_rows, empty  # noqa: F401
from logweir.llm import byte_bpe, fingerprints, jaccard_join, lattice_lm, line_crf, mixing, toxicity
from logweir.llm.line_dedup import line_dedup
from logweir.llm.quality_rules import base_measures, keep_good, quality_rules
from logweir.llm.url_filters import Rule, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


# --- op1: mixing


def test_targets_reshare_what_exceeds_three_times_a_source():
    assert mixing.targets([10, 10, 10]) == [18.75, 7.5, 3.75]
    assert mixing.targets([1, 100, 100]) == pytest.approx([3.0, 198 * 2 / 3, 198 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(out) == list(range(n))


def test_mix_meets_targets_and_bounds(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = mixing.mix_sizes(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    assert rows == mixing.mix_sizes(docs.repartition(7)).orderBy("doc_id").collect() or sorted(rows) == sorted(mixing.mix_sizes(docs.repartition(7)).collect())
    text = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()}
    taken, target = Counter(), {}
    for r in rows:
        assert r.size == text[r.doc_id][1]
        taken[text[r.doc_id][0]] += r.taken
        target[text[r.doc_id][0]] = r.target
    assert sum(target.values()) == pytest.approx(sum(n for _, n in text.values()))
    for source, want in target.items():
        assert abs(taken[source] - want) <= max(130, 0.03 * want)


def test_mix_takes_words_in_their_documents(spark, awkward, empty):
    sizes = {}
    for r in mixing.mix_sizes(awkward, block=16).collect():
        sizes.setdefault(r.doc_id, []).append((r.size, r.taken))
    assert sum(map(len, sizes.values())) == awkward.count()
    out = mixing.mixed_documents(awkward, block=16)
    assert out.columns == awkward.columns
    words = Counter()
    texts = defaultdict(set)
    for r in awkward.collect():
        texts[r.doc_id].update(WORD.findall(r.text or ""))
    for r in out.collect():
        found = WORD.findall(r.text)
        words[r.doc_id] += len(found)
        assert set(found) <= texts[r.doc_id] and r.n_chars == len(r.text)
    assert words == {i: sum(t for _, t in rows) for i, rows in sizes.items() if sum(t for _, t in rows)}
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# --- op2, op10: lines and rules


def test_line_dedup_is_relative_to_the_host(spark, awkward, empty):
    rows = [(i, f"menu  Top\nown words {i}\n\nMENU top", "a") for i in range(30)] + [(100 + i, f"menu top\nother {i}", "b") for i in range(2)]
    out = {r.doc_id: r.text for r in line_dedup(docs_of(spark, rows)).collect()}
    assert out[3] == "own words 3\n" and out[100] == "menu top\nother 0"
    copies = docs_of(spark, [(i, "one line\nand another", "a") for i in range(50)])
    assert {r.text for r in line_dedup(copies).collect()} == {"one line\nand another"}
    assert line_dedup(awkward).columns == awkward.columns and line_dedup(awkward).count() == awkward.count()
    assert line_dedup(empty).count() == 0


def brute_repeats(text):
    words = WORD.findall(text or "")
    seen, inside = defaultdict(list), set()
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    for places in seen.values():
        if len(places) > 1:
            inside.update(p + k for p in places for k in range(8))
    return len(inside)


def test_repeated_words(spark):
    texts = ["a " * 9, "a " * 8, "b " + "a b c d e f g h " * 3 + "x", " ".join(map(str, range(50))) + " " + " ".join(map(str, range(20, 35))), "", None]
    rows = base_measures(docs_of(spark, list(zip(range(6), texts, "aaaaaa")))).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_quality_rules_reject_depleted_documents(spark, awkward, empty):
    shared = "the very same words stand on each of these pages again and again for no reason at all today"
    rows = [(i, f"{shared}\n" + (" ".join(f"own{i}x{k}" for k in range(60)) if i % 2 else f"tiny{i} text"), "a") for i in range(300)]
    out = {r.doc_id: r for r in quality_rules(docs_of(spark, rows)).collect()}
    assert out[1].kept and not out[2].kept and not out[2].base_failed and out[2].n_left_words == 2
    kept = keep_good(awkward)
    assert kept.columns == awkward.columns
    good = {(r.doc_id, r.n_words) for r in quality_rules(awkward).where("kept").collect()}
    assert {(r.doc_id, len(WORD.findall(r.text))) for r in kept.collect()} == good
    assert kept.where("doc_id = 3").count() == 3
    assert quality_rules(empty).count() == 0 and keep_good(empty).count() == 0


# --- op3: URL filters


def test_links_spread_trust_and_distrust(spark):
    link = lambda h: f'<a href="http://{h}/x">'
    pages = [
        (1, "http://good.test/", link("friend.test")), (2, "HTTP://Friend.test/a", link("fan.test")), (3, "http://fan.test/", ""),
        (4, "http://bad.test/", ""), (5, "http://shill.test/", link("bad.test") * 2 + "<a href='//shill.test/'>"), (6, None, None),
        (7, "no scheme", ""), (8, "http://sub.bad.test/ok/1?x", ""), (8, "http://sub.bad.test/ok/1?x", ""), (9, "http://far.test", link("shill.test")),
    ]
    frame = spark.createDataFrame([(*p, "rule", "host") for p in pages], "page_id BIGINT, url STRING, html STRING, rule STRING, host STRING")
    rules = [Rule("allow", "good.test", "/"), Rule("block", "bad.test", "/"), Rule("allow", "bad.test", "/ok/")]
    rows = url_filters(frame, rules).collect()
    found = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    assert {i: r.verdict for i, r in found.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block"}
    assert found[8].rule == "bad.test/ok/" and found[2].host == "friend.test" and found[6].host == "" and found[9].path == ""
    assert found[2].trust > found[3].trust > 0 and found[5].distrust > found[9].distrust > 0
    assert url_filters(frame.limit(0), rules).count() == 0


# --- op4, op6: classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def held_out(rows, labels, label):
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    return [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


@pytest.mark.parametrize(("operator", "label", "least"), [(toxicity.toxicity, "toxic", 0.9), (line_crf.line_quality, "quality", 0.95)])
def test_classifiers(spark, labelled, awkward, empty, operator, label, least):
    docs, labels = labelled
    rows = operator(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    pairs = held_out(rows, labels, label)
    assert sum(p == t for p, t in pairs) / len(pairs) >= least
    out = operator(awkward, labels).collect()
    assert len(out) == awkward.count() and len({r.score for r in out if r.doc_id == 3}) == 1
    assert operator(empty, labels).count() == 0 and operator(awkward, labels.limit(0)).count() == awkward.count()


def test_long_texts_train_as_a_whole(spark):
    good, bad = "A sound line of words stands here for once.", "buy $$ now ## click"
    rows = [(i, "\n".join([good if i % 2 else bad] * 30), "a") for i in range(40)]
    rows += [(100 + i, "\n".join([good] * 50 + [bad] * 3000), "a") for i in range(20)]  # their heads say otherwise
    labels = spark.createDataFrame([(i, int(i < 100 and i % 2), 0) for i, *_ in rows], "doc_id BIGINT, quality INT, toxic INT")
    out = line_crf.line_quality(docs_of(spark, rows), labels).collect()
    assert all(r.predicted == (r.doc_id < 100 and r.doc_id % 2) for r in out)


def test_marginals_equal_enumeration():
    field = line_crf.LineField(np.zeros(1), np.ones(1))
    field.tie = 0.7
    u = np.array([0.3, -1.2, 2.0, 0.1])
    weights = np.zeros(4)
    total = 0.0
    for code in range(16):
        y = [(code >> i) & 1 for i in range(4)]
        w = math.exp(sum(u[i] * y[i] for i in range(4)) + field.tie * sum(a == b for a, b in zip(y, y[1:])))
        total += w
        weights += w * np.array(y)
    assert field.marginals(u) == pytest.approx(weights / total)


# --- op5: Jaccard join


def brute_components(rows):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((str(rows[i][0]), len(sets[i]), str(least.get(find(i)) if sets[i] else rows[i][0])) for i in range(len(rows)))


def found_components(frame):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in frame.collect())


def near_copies(seed, n=160):
    import random

    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    rows = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 14, 40, 120, 300]))]
        for _ in range(n // 6):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words[: len(words) - rng.randint(0, 1)]), f"f{family}"))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 16)])
def test_jaccard_join_equals_brute_force(spark, seed, block):
    rows = near_copies(seed)
    assert found_components(jaccard_join.jaccard_join(docs_of(spark, rows), block)) == brute_components(rows)


def test_jaccard_join_of_awkward_rows(spark, awkward, awkward_rows, empty):
    assert found_components(jaccard_join.jaccard_join(awkward)) == brute_components(awkward_rows)
    left = jaccard_join.one_of_each(awkward)
    assert left.columns == awkward.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(3) == 1 and 109 not in ids and 105 not in ids and {100, 101, 102, 103, 104} <= set(ids)
    assert jaccard_join.jaccard_join(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0


def test_jaccard_join_takes_shingle_and_percent(spark):
    sets = {}
    rows = near_copies(3)
    # 4 of 5 and 29 of 36 shingles of five words are linked at 80 %; 30 of 37 of four words are not at 85 %.
    rows += [(900, "a b c d e f g h", "x"), (901, "a b c d e f g h i", "x")]
    rows += [(910, " ".join(f"u{i}" for i in range(40)), "x"), (911, " ".join(f"u{i}" for i in range(33)), "x")]
    for i, text, _ in rows:
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    near = {i: {i} for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if 100 * len(a & b) >= 80 * len(a | b) and near[i] is not near[j]:
                near[i] |= near[j]
                for k in near[j]:
                    near[k] = near[i]
    want = {i: min(group) for i, group in near.items()}
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs_of(spark, rows), 16, shingle=5, percent=80).collect()}
    assert found == want and found[901] == 900 and found[911] == 910
    assert {r.doc_id for r in jaccard_join.one_of_each(docs_of(spark, rows), shingle=5, percent=80).collect()} == set(want.values())
    with pytest.raises(ValueError):
        jaccard_join.jaccard_join(docs_of(spark, rows), percent=60)


def test_one_of_each_keeps_what_is_linked_with_nothing(spark):
    texts = [" ".join(f"{name}{i}" for i in range(12)) for name in "abcde"]
    rows = [(None, texts[0], "x"), (None, texts[1], "x"), (None, texts[1], "x"), (None, "", "x"), (None, " ", "x"), (None, None, "x"),
            (7, texts[2], "x"), (7, texts[3], "x"), (7, "", "x"), (8, texts[3], "x"), (9, texts[4], "x"), (None, texts[4], "x")]
    left = sorted((str(r.doc_id), r.text or "") for r in jaccard_join.one_of_each(docs_of(spark, rows)).collect())
    unlinked = [("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3]), ("9", texts[4])]
    assert left == sorted([*unlinked, ("None", ""), ("None", " "), ("None", ""), ("7", "")])


def broadcast_rows(node):
    """The rows of each broadcast of a plan that ran."""
    kind = node.getClass().getSimpleName()
    if kind == "BroadcastExchangeExec":
        yield node.metrics().apply("numOutputRows").value()
    if kind == "AdaptiveSparkPlanExec":
        below = [node.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [node.plan()]
    else:
        below = [node.children().apply(i) for i in range(node.children().size())]
    for x in below:
        yield from broadcast_rows(x)


def test_heads_of_components_are_not_broadcast_for_each_part(spark):
    rows = [(i, f"some words that stand in text {i} alone", "x") for i in range(2000)]
    rows += [(5000 + i, "one text that stands on a great many rows", "x") for i in range(1100)] + [(None, "", "x"), (9, "", "x")]
    frame = jaccard_join.jaccard_join(docs_of(spark, rows), shingle=20)
    found = sorted((str(r.doc_id), str(r.component_id)) for r in frame.collect())
    assert found == sorted((str(i), str(5000 if i is not None and i >= 5000 else i)) for i, *_ in rows)
    assert max(broadcast_rows(frame._jdf.queryExecution().executedPlan()), default=0) <= 2 * len(rows)


def test_a_passage_of_many_texts_makes_them_no_candidates(spark, monkeypatch):
    met, told_apart = [], jaccard_join.told_apart
    monkeypatch.setattr(jaccard_join, "told_apart", lambda rows: met.append(rows) or told_apart(rows))
    passage = " ".join(f"shared{k}" for k in range(16))
    rows = [(i, " ".join([passage, *(f"own{i}x{k}" for k in range(200))]), "x") for i in range(300)]
    rows += [(300, rows[7][1] + " end", "x")]
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs_of(spark, rows)).collect()}
    assert found == {i: 7 if i == 300 else i for i in range(301)}
    assert met[0].groupBy("key").count().agg(F.max("count")).first()[0] == 2


def test_packed_segments_are_counted_by_class():
    keys = [np.array([5 << 40, 9, -7]), np.array([9, 5 << 40]), np.array([9, 11])]
    rows = [jaccard_join._packed(keys, [-3, 4, 4], [3, 2, 2], 1), jaccard_join._packed(keys[:1], [-3], [3], 1)]
    out = jaccard_join._shared(jaccard_join.pa.Table.from_batches(rows))
    last = (1 << 48) - 1
    assert sorted(zip(*(out[c].to_pylist() for c in ("key", "class", "n")))) == [(9, 4, 2), (9, -3 & last, 2), (5 << 40, 4, 2), (5 << 40, -3 & last, 2)]


def test_segments_share_of_every_linked_pair():
    rng = np.random.default_rng(3)
    edges = jaccard_join.band_edges(2000)
    for n in (7, 8, 20, 77, 500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = n * 15 // 185
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, gone).astype(np.uint64)]))
        keys = [set(np.concatenate(list(jaccard_join.segment_keys(s, edges)))) for s in (a, b)]
        assert keys[0] & keys[1]


# --- op7: LM scoring


def test_lattice_sums_all_segmentations():
    starts, insides = ["a", "ab", "b"], ["a", "b", "ba"]
    lattice = lattice_lm.Lattice(starts, insides, np.log([0.5, 0.3, 0.2]), np.log([0.6, 0.3, 0.1]), 0.4)

    def total(word, kind=0):
        pieces, logs = (starts, lattice.logs[0]) if kind == 0 else (insides, lattice.logs[1])
        out = 0.0
        for k in range(1, len(word) + 1):
            p = math.exp(logs[pieces.index(word[:k])]) * (1 - lattice_lm.SPARE) if word[:k] in pieces else 0.0
            p += lattice_lm.SPARE / lattice_lm.CODE_POINTS if k == 1 else 0.0
            out += p * (0.4 if k == len(word) else 0.6 * total(word[k:], 1))
        return out

    words = ["a", "ab", "aba", "abba", "xyz", "b" * 30]
    got = lattice.log_probability(words)
    assert got == pytest.approx([math.log(total(w)) for w in words[:5]] + [got[5]])


def test_lm_scores_equal_brute_force(spark, awkward, awkward_rows, empty):
    rows = lattice_lm.lm_scores(awkward, head=50).collect()
    assert len(rows) == len(awkward_rows)
    texts = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t, _ in awkward_rows]
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, own in texts if not held(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), held(i), len(own), sum(counts[w] > 0 for w in own), n,
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 4)) for i, own in texts
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert {round(r.score, 6) for r in rows if r.n_tokens == 1} and lattice_lm.lm_scores(empty).count() == 0


# --- op8: fingerprints


def test_sketches_merge_and_contain(spark, empty):
    long = " ".join(f"w{i}" for i in range(3000))
    short = " ".join(f"w{i}" for i in range(1000, 1400))
    rows = docs_of(spark, [(1, long, "a"), (2, short, "a"), (3, "", "a"), (4, "tiny", "a")])
    own = {r.doc_id: r.sketch for r in fingerprints.fingerprints(rows).collect()}
    assert own[3] == [] and len(own[4]) == 1
    frame = spark.createDataFrame([(own[2], own[1], own[4])], "a array<string>, b array<string>, c array<string>")
    r = frame.select(fingerprints.containment("a", "b").alias("in"), fingerprints.containment("b", "a").alias("of"), fingerprints.merged("a", "b").alias("m")).first()
    assert r["in"] == 1.0 and abs(r["of"] - 396 / 2996) < 0.06 and r.m == own[1]
    assert fingerprints.edited_likeness(empty).count() == 0


def test_next_documents_across_ranges(spark):
    rows = [(i * 7 % 101, f"text number {i}", "a") for i in range(101)] + [(5, "again", "a"), (None, "no id", "a")]
    found = fingerprints.with_next(docs_of(spark, rows).select("doc_id", "text"), rows_per_range=10).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = {(a[0], a[1]): b[1] for a, b in zip(order, order[1:] + order[:1])}
    assert {(r.doc_id, r.text): r.next.text for r in found} == want and len(found) == len(rows)


# --- op9: byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.RANKS), "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_encoding_equals_the_library(reference):
    import random

    rng = random.Random(4)
    small = byte_bpe.Codec(public_tokenizers.path(byte_bpe.RANKS), leaf=5)
    parts = ["a", "b'", "re", " ", "  ", "\n", "\r\n", "'s", "é", "12", "漢", "😀", "　", " ", "!", "'r", "e", "\t", "word", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        ids = small.encode(text)
        assert ids == reference.encode_ordinary(text) and small.decode(ids) == text.encode()
    assert small.encode("z" * 3000) == reference.encode_ordinary("z" * 3000)


def test_digests_and_round_trip(spark, awkward, awkward_rows, empty, reference):
    want = []
    for i, text, _ in awkward_rows:
        ids = reference.encode_ordinary(text or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(awkward).collect()) == sorted(want)
    back = byte_bpe.decode(byte_bpe.encode(awkward)).select(F.decode("bytes", "utf-8").alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t, _ in awkward_rows)
    assert byte_bpe.digests(empty).count() == 0
