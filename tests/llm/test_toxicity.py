import math
import random
from collections import defaultdict

import numpy as np

from logweir.llm import toxicity

TEXTS = [
    ("you rotten egg you", 1), ("what a rotten egg", 1), ("a rotten apple", 1), ("rotten egg rotten egg rotten egg", 1),
    ("what a nice day", 0), ("a nice egg for you", 0), ("what a nice apple", 0), ("the day was nice", 0), ("the egg was nice", 0),
    ("what a rotten egg", 1), ("", 0), ("123 !!", 0),
]


def brute(texts, several):
    """log-probability by class of `second` after `first`, from the definition."""
    docs, places = {t: c for t, c in texts}, lambda: (set(), set())
    word, pair, after = defaultdict(places), defaultdict(places), defaultdict(set)
    for text, c in docs.items():
        w, seen = ["", "", *toxicity.tokens(text)], set()
        for a, b, x in zip(w, w[1:], w[2:]):
            for table, key, left in ((word, x, b), (pair, (b, x), a)):
                if key not in seen:
                    seen.add(key)
                    table[key][c].add(left)
            after[x].add(b)
    word, pair = ({k: [len(s) for s in v] for k, v in table.items()} for table in (word, pair))

    def discount(table, c):
        n1, n2 = (sum(v[c] == k for v in table.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 else 0.5

    every, types = sum(len(v) for v in after.values()), len(after)
    known = {x for x, v in word.items() if sum(v) >= several}

    def unigram(x, c):
        n = sum(v[c] for v in word.values())
        own = lambda y: max(word[y][c] - discount(word, c), 0) / n
        shared = ((len(after[x]) if x in known else 0) + 0.5) / (every + 0.5 * (types + 1))
        return (own(x) if x in known else 0) + (1 - sum(own(y) for y in known)) * shared

    def logp(first, second, c):
        first = first if first in known else None
        left = {k: v for k, v in pair.items() if k[0] == first and first is not None}
        n = max(sum(v[c] for v in left.values()), 1)
        own = lambda v: max(v[c] - discount(pair, c), 0) / n
        frequent = {k: v for k, v in left.items() if sum(v) >= several and k[1] in known}
        back = max(1 - sum(own(v) for v in frequent.values()), 1e-6)
        hit = own(frequent[first, second]) if (first, second) in frequent else 0
        return math.log(hit + back * unigram(second, c))

    return logp


def test_probabilities_equal_brute_force_kneser_ney(spark):
    rows = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(TEXTS)], "doc_id BIGINT, text STRING, label INT")
    for several in (1, 3):
        models, logp = toxicity.train(rows.repartition(3), several), brute(TEXTS, several)
        for text in ["what a rotten egg you unseen rotten", "the nice day was nice", "rotten"]:
            words = toxicity.tokens(text)
            got = models.logs(models.words(text))
            want = [[logp(a, b, c) for c in (0, 1)] for a, b in zip(["", *words], words)]
            assert np.allclose(got, want)


def test_held_out_recall_on_the_test_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    docs = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = [(r.score, known[r.doc_id]) for r in toxicity.toxicity(docs, labels).where("held_out").collect() if r.doc_id in known]
    clean = sorted(s for s, t in rows if t == 0)
    bar = clean[int(0.9 * len(clean))]
    assert sum(s > bar for s, t in rows if t == 1) >= 0.92 * sum(t for _, t in rows)


def test_long_texts_and_copies_count_once(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choices("bcdfghaeiou", k=5)) for _ in range(300))
    rows = [(i, f"plain words number{i % 5} here", 0) for i in range(20)] + [(50 + i, long, 1) for i in range(30)]
    models = toxicity.train(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT"), 5)
    assert not {toxicity.name(w) for w in long.split()} & set(models.ids)
