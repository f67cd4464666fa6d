"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models of letter words, one of toxic and one of ordinary texts. An expression
counts once for each document of a class it stands in, and only once for those where its first place follows
the same word: neither a long text that repeats it nor copies of a text add to it. Counts are
discounted by what counts of one and two say (Kneser-Ney's estimate), and what that frees
goes to the level below: from pairs to words, from words to continuation counts over both
classes, which are shared. Rare expressions, of fewer than `several` places in
both classes together, have these shared counts only, so whatever chance gave one of
them to a class, it scores alike in both. What the tasks are sent are the others, which the
bounded training rows keep few.

A text is scored by log-likelihood ratios, normalised by length: of the whole text and of
its most toxic windows of several lengths, as a long text may be toxic in one sentence. A
logistic regression on the training rows makes these a probability.

Defined cases: a NULL, empty or wordless text has ratios of 0, thus the score of a text
without evidence. Repeated rows score alike. Labels are joined by doc_id; of repeated
labels the larger counts; NULL ids have none. Without labels of both classes the score is
0 for all. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import written
from logweir.llm.learning import apply_logistic, class_counts, fold, labelled, logistic

LETTERS = re.compile(r"[^\W\d_]+")
WINDOWS, TIERS = (1, 4, 16), (5, 20, 80)
FEATURES = 1 + len(TIERS) * len(WINDOWS)
#: Texts whose expressions are handed on at once.
SLICE = 50


def tokens(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


@dataclass
class Models:
    """Words have numbers; 0 is any word without an entry."""

    ids: dict[int, int]  # by name
    unigram: np.ndarray  # (words, 2): probability by class
    places: np.ndarray  # (words,): places of both classes together
    back: np.ndarray  # (words, 2): mass that a context leaves to the unigrams
    pairs: np.ndarray  # sorted context * words + word
    kept: np.ndarray  # (pairs, 2): discounted probability of a pair

    def words(self, text: str) -> np.ndarray:
        return np.array([self.ids.get(name(t), 0) for t in tokens(text)], dtype=np.int64)

    def logs(self, word: np.ndarray) -> np.ndarray:
        """(words, 2): log-probability by class of each word after the one before it."""
        before = np.concatenate([[0], word[:-1]])
        p = self.back[before] * self.unigram[word]
        key = before * len(self.unigram) + word
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        if len(self.pairs):
            hit = self.pairs[at] == key
            p[hit] += self.kept[at[hit]]
        return np.log(p)

    def features(self, text: str) -> list[float]:
        """Log-likelihood ratios, toxic over ordinary, by length: of the text, and of its most toxic windows.

        Windows are taken of well-known words only, once for each number in TIERS: the more places a
        word has, the less its ratio owes to chance, and the regression weighs that.
        """
        word = self.words(text)
        if not len(word):
            return [0.0] * FEATURES
        r = self.logs(word) @ np.array([-1.0, 1.0])
        out = [float(r.mean())]
        for tier in TIERS:
            sums = np.concatenate([[0.0], np.cumsum(np.where(self.places[word] >= tier, r, 0.0))])
            out += [float(((sums[w:] - sums[:-w]) / w).max()) if len(r) >= w else float(sums[-1] / w) for w in WINDOWS]
        return out


def name(token: str) -> int:
    """A signed 64-bit name of a word."""
    return xxhash.xxh64_intdigest(token) - 2**63


#: Names of no word (the place before a text's first), and of the context of words counted by themselves.
NONE, ALONE = name(""), 0


def expressions(text: str, label: int) -> np.ndarray:
    """Rows (first, second, before, label): each distinct pair and word of a text once, with the word before its first place."""
    second = np.array([name(t) for t in tokens(text)], dtype=np.int64)
    first = np.concatenate([[NONE], second[:-1]]) if len(second) else second
    before = np.concatenate([[NONE], first[:-1]]) if len(second) else second
    _, pair = np.unique(first * np.int64(31) ^ second * np.int64(-7046029254386353131), return_index=True)
    _, word = np.unique(second, return_index=True)
    rows = [(first[pair], second[pair], before[pair]), (np.full(len(word), ALONE), second[word], first[word])]
    found = np.concatenate([np.stack(r, axis=1) for r in rows]) if len(second) else np.zeros((0, 3), np.int64)
    return np.column_stack([found, np.full(len(found), label)])


def counted(rows: DataFrame) -> DataFrame:
    """(first, second, n0, n1): by class, the different words before a pair, of its first place in each text; words stand alone after ALONE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                pairs = zip(part.column("text"), part.column("label").to_pylist(), strict=True)
                found = np.unique(np.concatenate([expressions(t.as_py(), c) for t, c in pairs]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.T], ["first", "second", "before", "label"])

    found = rows.select("text", "label").mapInArrow(run, "first bigint, second bigint, before bigint, label bigint")
    # One shuffle for both steps.
    found = found.repartition("first", "second").dropDuplicates(["first", "second", "label", "before"])
    return found.groupBy("first", "second").agg(*[F.count_if(F.col("label") == c).alias(f"n{c}") for c in (0, 1)])


def discounts(counts: DataFrame) -> np.ndarray:
    """What a count of either class is short of: n1 / (n1 + 2 n2), from how many expressions have a count of 1 and of 2."""
    ones = counts.agg(*[F.count_if(F.col(f"n{c}") == k) for c in (0, 1) for k in (1, 2)]).first()
    return np.array([n1 / (n1 + 2 * n2) if n1 else 0.5 for n1, n2 in (ones[:2], ones[2:])], float)


def train(rows: DataFrame, several: int) -> Models:
    """Both models from labelled rows; the driver receives expressions of `several` places only."""
    every_count = written(counted(rows))
    pairs, words = every_count.where(F.col("first") != ALONE), every_count.where(F.col("first") == ALONE)
    after = pairs.groupBy("second").count()
    total = words.agg(F.sum("n0"), F.sum("n1"), F.count(F.lit(1))).first()
    n, types, every = np.array([total[0] or 0, total[1] or 0], float), float(total[2] or 0), float(pairs.count())
    common = lambda df: df.where(F.col("n0") + F.col("n1") >= several)
    known = common(words).drop("first").join(after, "second").orderBy("second").toArrow().to_pylist()
    ids = {r["second"]: i for i, r in enumerate(known, 1)}
    size = len(ids) + 1
    own, shared = np.zeros((size, 2)), np.full(size, 0.5 / (every + 0.5 * (types + 1)))
    for i, r in enumerate(known, 1):
        own[i] = r["n0"], r["n1"]
        shared[i] = (r["count"] + 0.5) / (every + 0.5 * (types + 1))
    own = np.maximum(own - discounts(words), 0) / np.maximum(n, 1)
    unigram = own + (1 - own.sum(axis=0)) * shared[:, None]
    follows = np.ones((size, 2))
    left = pairs.where(F.col("first") != NONE).groupBy("first").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    for r in common(left).toArrow().to_pylist():
        if r["first"] in ids:
            follows[ids[r["first"]]] = max(r["n0"], 1), max(r["n1"], 1)
    frequent = common(pairs.where(F.col("first") != NONE)).toArrow().to_pylist()
    at = sorted((ids[r["first"]] * size + ids[r["second"]], r["n0"], r["n1"]) for r in frequent if r["first"] in ids and r["second"] in ids)
    key = np.array([p[0] for p in at], dtype=np.int64)
    context = key // size
    kept = np.maximum(np.array([p[1:] for p in at], dtype=float).reshape(-1, 2) - discounts(pairs), 0) / follows[context]
    back = np.ones((size, 2))
    np.subtract.at(back, context, kept)
    places = np.array([0, *[r["n0"] + r["n1"] for r in known]], float)
    return Models(ids, unigram, places, np.maximum(back, 1e-6), key, kept)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4_000,
    several: int = 5,
    threshold: float = 0.3,
) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`."""
    sizes = class_counts(labels, "toxic")
    rows = labelled(docs, labels, "toxic", per_class)
    none = min(sizes) == 0
    models = None if none else train(rows, several)
    weights = None
    if models:
        sent = docs.sparkSession.sparkContext.broadcast(models)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [sent.value.features(t.as_py()) for t in batch.column("text")]
                yield pa.record_batch({"x": pa.array(x, pa.list_(pa.float64())), "label": batch.column("label")})

        found = rows.select("text", "label").mapInArrow(measure, "x array<double>, label int").collect()  # 2 * per_class rows at most
        x, y = np.array([r["x"] for r in found]).reshape(len(found), FEATURES), np.array([r["label"] for r in found], float)
        # The classes weigh as in the whole of the labels, not as in the bounded sample.
        weight = np.where(y == 1, sizes[1] / max(y.sum(), 1), sizes[0] / max((1 - y).sum(), 1))
        weights = logistic(x, y, weight) if len(set(y)) == 2 else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if weights is None:
                out = np.zeros(batch.num_rows)
            else:
                x = np.array([sent.value.features(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, len(weights) - 1)
                out = apply_logistic(weights, x)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(out, pa.float64())})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(score, "doc_id bigint, score double").select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
