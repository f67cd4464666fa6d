"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line gets a label, good or bad. Its unary score is linear in features of the line
and of its two neighbours; a transition score ties neighbouring labels. The field is
trained by gradient ascent on the likelihood of labelled texts, whose lines all carry the
text's label, from a bounded sample of rows. A text's quality is the mean of its lines'
forward-backward marginals for "good", weighted by their length, taken through a logistic
regression on the training rows together with the text's unary mean.

Line features are shares of character classes, counted over the UTF-8 bytes of the whole
text in one pass, so very long texts cost their length.

Defined cases: a NULL or empty text is one empty line. Repeated rows score alike. Labels
are joined by doc_id; of repeated labels the larger counts; NULL ids have none. Without
labels of both classes the score is 1 if all are good, else 0. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.learning import apply_logistic, class_counts, fold, labelled, logistic, sigmoid

KINDS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789",
         "blank": " \t\r\v\f", "stop": ".,;:'\"?()-", "loud": "!", "mark": "#*$%&<>=_/\\[]{}@^~+`", "bar": "|"}
#: A kind for each byte; bytes of other characters are the last kind.
TABLE = np.full(256, len(KINDS), dtype=np.int64)
for _kind, _chars in enumerate(KINDS.values()):
    TABLE[[ord(c) for c in _chars]] = _kind
N_KINDS = len(KINDS) + 1
OWN = N_KINDS + 4


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with those of its neighbours, length of each line)."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    is_end = data == 10
    n = int(is_end.sum()) + 1
    of = np.cumsum(is_end) - is_end
    inside = ~is_end
    kinds = TABLE[data[inside]]
    counted = np.bincount(of[inside] * N_KINDS + kinds, minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
    length = counted.sum(axis=1)
    share = counted / np.maximum(length, 1)[:, None]
    blank = kinds == 3
    word_starts = ~blank & np.concatenate([[True], blank[:-1] | (np.diff(of[inside]) > 0)]) if len(kinds) else np.zeros(0, bool)
    words = np.bincount(of[inside][word_starts], minlength=n).astype(float)
    lines = text.split("\n")
    seen: set[str] = set()
    again = np.zeros(n)
    spread = np.ones(n)
    for i, line in enumerate(lines):
        again[i] = line in seen
        seen.add(line)
        own = line.split()
        spread[i] = len(set(own)) / len(own) if own else 1.0
    own = np.column_stack([share, np.log1p(words), length / np.maximum(words, 1) / 10, spread, again])
    zero = np.zeros((1, OWN))
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero])]), length


class LineField:
    """Scores: `unary` @ standardised features for "good" against "bad"; `tie` for equal neighbouring labels."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.unary, self.bias, self.tie = np.zeros(len(mean)), 0.0, 0.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -8, 8) @ self.unary + self.bias

    def marginals(self, u: np.ndarray) -> np.ndarray:
        """P(good) of each line by the forward-backward recursion, on log-odds of the two labels."""
        n, t = len(u), math.exp(min(max(self.tie, -20), 20))
        ahead, behind = [0.0] * n, [0.0] * n
        for i in range(1, n):
            ahead[i] = _passed(ahead[i - 1] + u[i - 1], t)
        for i in range(n - 2, -1, -1):
            behind[i] = _passed(behind[i + 1] + u[i + 1], t)
        return sigmoid(np.array(ahead) + u + np.array(behind))

    def quality(self, features: np.ndarray, length: np.ndarray) -> list[float]:
        """Log-odds of the length-weighted mean marginal, and the length-weighted mean score."""
        u = self.scores(features)
        weight = (length + 1e-6) / (length.sum() + 1e-6 * len(length))
        good = min(max(float(weight @ self.marginals(u)), 1e-4), 1 - 1e-4)
        return [math.log(good / (1 - good)), float(weight @ np.clip(u, -10, 10))]


def _passed(odds: float, t: float) -> float:
    """Log-odds handed on through a transition that weighs equal labels by t against 1."""
    e = math.exp(min(max(odds, -30.0), 30.0))
    return math.log((t * e + 1) / (e + t))


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.1) -> LineField:
    """Maximise the weighted conditional log-likelihood of constant label chains (Adam).

    For two labels with one tie the gradient needs the marginals of lines and of equal
    neighbours; chains of equal number of lines are handled together.
    """
    every = np.vstack([f for f, _ in texts])
    field = LineField(every.mean(axis=0), every.std(axis=0) + 1e-6)
    x = np.clip((every - field.mean) / field.scale, -8, 8)
    ends = np.cumsum([len(f) for f, _ in texts])
    starts = ends - [len(f) for f, _ in texts]
    y = np.repeat(labels, ends - starts)
    # A text weighs the same however many lines it has.
    per_line = np.repeat(weight / (ends - starts), ends - starts)
    per_text = weight / (ends - starts)
    theta, m, v = np.zeros(x.shape[1] + 2), 0.0, 0.0
    total = weight.sum()
    longest = int((ends - starts).max())
    order = np.argsort(starts - ends, kind="stable")  # longest chains first: step i has a prefix of them
    begin, size = starts[order], (ends - starts)[order]
    for step in range(1, steps + 1):
        field.unary, field.bias, field.tie = theta[:-2], theta[-2], theta[-1]
        u = x @ field.unary + field.bias
        t = math.exp(field.tie)
        ahead, behind = np.zeros(len(u)), np.zeros(len(u))
        hand = lambda o: np.log((t * np.exp(np.clip(o, -30, 30)) + 1) / (np.exp(np.clip(o, -30, 30)) + t))  # noqa: B023, E731
        for i in range(1, longest):
            at = begin[size > i] + i
            ahead[at] = hand(ahead[at - 1] + u[at - 1])
        for i in range(1, longest):
            at = begin[size > i] + size[size > i] - 1 - i
            behind[at] = hand(behind[at + 1] + u[at + 1])
        p = sigmoid(ahead + u + behind)
        left, right = ahead + u, u + behind
        inner = np.ones(len(u), bool)
        inner[ends - 1] = False
        i = np.flatnonzero(inner)
        a, b = np.clip(left[i], -30, 30), np.clip(right[i + 1], -30, 30)
        same = t * (1 + np.exp(a + b))
        same = same / (same + np.exp(a) + np.exp(b))
        pull = per_line * (y - p)
        grad = np.concatenate([x.T @ pull, [pull.sum()], [(per_line[i] * (1 - same)).sum()]]) / total
        grad[:-2] -= 1e-3 * theta[:-2]
        grad[-1] -= 0.3 * theta[-1] * per_text.sum() / total
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.unary, field.bias, field.tie = theta[:-2], float(theta[-2]), float(theta[-1])
    return field


def _weights(y: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """The classes weigh as in the whole of the labels, not as in the bounded sample."""
    return np.where(y == 1, sizes[1] / max(y.sum(), 1), sizes[0] / max((1 - y).sum(), 1))


def line_quality(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 2_000,
    longest: int = 1_000,
    threshold: float = 0.7,
) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`.

    Training takes at most `per_class` labelled rows of each class. The field is fitted to
    those of `longest` lines at most, the regression to all of them; texts are always taken whole.
    """
    sizes = class_counts(labels, "quality")
    field = weights = None
    if min(sizes):
        rows = labelled(docs, labels, "quality", per_class)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [(*line_features(t.as_py()), c) for t, c in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True)]
                own = [o for o in own if len(o[1]) <= longest]
                yield pa.record_batch({
                    "label": pa.array([c for *_, c in own], pa.int32()),
                    "x": pa.array([f.astype(np.float32).ravel() for f, *_ in own], pa.list_(pa.float32())),
                    "n": pa.array([n for _, n, _ in own], pa.list_(pa.float64())),
                })

        found = rows.select("text", "label").mapInArrow(measure, "label int, x array<float>, n array<double>").toArrow()
        flat = lambda v: v.values.to_numpy(zero_copy_only=False).astype(float)
        texts = [(flat(x).reshape(-1, 3 * OWN), flat(n)) for x, n in zip(found["x"], found["n"], strict=True)]
        y = found["label"].to_numpy().astype(float)
        if len(set(y)) == 2:
            field = fit(texts, y, _weights(y, sizes))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [field.quality(*line_features(t.as_py())) for t in batch.column("text")]
                yield pa.record_batch({"label": batch.column("label"), "x": pa.array(own, pa.list_(pa.float64()))})

        if field:
            found = rows.select("text", "label").mapInArrow(judge, "label int, x array<double>").collect()  # 2 * per_class rows
            y = np.array([r["label"] for r in found], float)
            weights = logistic(np.array([r["x"] for r in found]), y, _weights(y, sizes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if weights is None:
                out = np.full(batch.num_rows, float(sizes[1] > 0))
            else:
                x = np.array([field.quality(*line_features(t.as_py())) for t in batch.column("text")]).reshape(batch.num_rows, len(weights) - 1)
                out = apply_logistic(weights, x)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(out, pa.float64())})

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(score, "doc_id bigint, score double").select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

