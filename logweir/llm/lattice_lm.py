"""LM scoring by subword lattice likelihood.

A text is a row of tokens: its words (A-Z lower-cased), then one end. A word is spelled by
pieces of an existing vocabulary (a public tokenizer's file; its pieces and their order
are taken as they are, never trained). All segmentations of a word count: a log-space
forward recursion over the word's positions sums them to the word's marginal probability,

    lattice(w) = sum over segmentations of q (1 - q)^(pieces - 1) * product of p(piece),

with one distribution for pieces that begin a word and one for those inside, and q the
chance that a word ends. The piece scores start from the vocabulary's order and are fitted
to all training documents by expectation maximisation (forward-backward over the table of
distinct words; each weighs the same, as each gives the same mass to the lattice). A
training word is also an edge of its own over the whole lattice, with an absolutely
discounted count; the discounted mass goes to the lattice of pieces:

    p(w) = max(c - D, 0) / N + (D * V / N) * lattice(w).

This is a probability over all token rows. Words are scored once each, in a table of
words; a document's score is the sum over its tokens. The `head` most frequent words (a
fixed number) are sent to every task, which settles most tokens where they are read and
keeps frequent words from being hot keys; all others are joined by word, exactly.

Defined cases: a NULL or empty text is the end token alone. Characters that no piece
covers have a small uniform probability. Repeated rows are scored each. NULL ids belong to
the fold of an empty text. Without training rows every count is 0: the base is that of its
formula, and the lattice with its starting scores is the model. An empty table gives an
empty result. Extra columns are not read. Very long words cost their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import checkpoint
from logweir.llm.learning import fold

PIECES = "piece_bpe_32k.model"
START = "▁"
#: Longest piece looked for; the share of probability of single characters, over all code points.
LONGEST, SPARE, CODE_POINTS = 16, 1e-4, 0x110000
DISCOUNT = 0.75
#: Bytes of text cut into words at once; characters of words scored at once.
SLICE_BYTES, CHUNK = 8_000_000, 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """Slices of the texts: (first text, end, distinct words, each word's number among these, each word's text in the slice)."""
    start = 0
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    while start < len(texts):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + 4000]), SLICE_BYTES)))
        stop = min(stop, start + 4000, len(texts))
        # Both kernels are about ASCII only: A-Z, and the blanks 9 to 13 and 32.
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(start, stop - start)))
        flat = split.flatten().dictionary_encode()
        of = np.repeat(np.arange(stop - start), pc.list_value_length(split).to_numpy())
        number, names = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        if "" in names:  # what stands before a leading or behind a trailing blank
            real = number != names.index("")
            number, of = number[real], of[real]
        yield start, stop, names, number, of
        start = stop


class Lattice:
    """Pieces by a 64-bit rolling hash of their characters, apart for word starts and insides."""

    def __init__(self, starts: list[str], insides: list[str], log_start: np.ndarray, log_inside: np.ndarray, stop: float):
        self.sizes = (len(starts), len(insides))
        self.keys, self.order, self.maybe = [], [], []
        for pieces in (starts, insides):
            h = np.array([_hash(p) for p in pieces], dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            self.keys.append(h[order])
            self.order.append(order)
            # Most substrings are no piece: a bitmap of the hashes' first bits tells without a search.
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[h >> np.uint64(44)] = True
            self.maybe.append(maybe)
        self.set(log_start, log_inside, stop)

    def set(self, log_start: np.ndarray, log_inside: np.ndarray, stop: float) -> None:
        self.logs, self.stop = (log_start, log_inside), stop

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log weight, piece) of the edges [word, from, length - 1]; piece is -1 where there is none."""
        n, width = codes.shape
        most = min(LONGEST, width)
        weight, piece = np.full((n, width, most), -np.inf), np.full((n, width, most), -1, dtype=np.int32)
        for at in range(width):
            kind = int(at > 0)
            keys, order, logs = self.keys[kind], self.order[kind], self.logs[kind]
            h = np.zeros(n, dtype=np.uint64)
            for k in range(min(most, width - at)):
                h = h * BASE + codes[:, at + k] + np.uint64(1)
                hit = np.flatnonzero(self.maybe[kind][h >> np.uint64(44)])
                if len(hit):
                    found = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
                    right = keys[found] == h[hit]
                    hit, own = hit[right], order[found[right]]
                    weight[hit, at, k], piece[hit, at, k] = logs[own] + math.log(1 - SPARE), own
            spare = math.log(SPARE / CODE_POINTS)
            weight[:, at, 0] = np.logaddexp(weight[:, at, 0], spare)
            if at:
                weight[:, at] += math.log(1 - self.stop)
        return weight, piece

    def _forward(self, weight: np.ndarray) -> np.ndarray:
        n, width, most = weight.shape
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0.0
        for to in range(1, width + 1):
            k = np.arange(1, min(most, to) + 1)
            alpha[:, to] = _log_sum(alpha[:, to - k] + weight[:, to - k, k - 1])
        return alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Log of each word's marginal probability over all segmentations."""
        out = np.zeros(len(words))
        for at, codes in _by_length(words):
            weight, _ = self._edges(codes)
            out[at] = self._forward(weight)[:, -1] + math.log(self.stop)
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each start and inside piece over words with counts."""
        total = [np.zeros(self.sizes[0]), np.zeros(self.sizes[1])]
        for at, codes in _by_length(words):
            weight, piece = self._edges(codes)
            alpha = self._forward(weight)
            n, width, most = weight.shape
            beta = np.full((n, width + 1), -np.inf)
            beta[:, width] = 0.0
            for i in range(width - 1, -1, -1):
                k = np.arange(1, min(most, width - i) + 1)
                beta[:, i] = _log_sum(weight[:, i, k - 1] + beta[:, i + k])
            share = counts[at]
            for i in range(width):
                k = np.arange(1, min(most, width - i) + 1)
                logs = alpha[:, i, None] + weight[:, i, k - 1] + beta[:, i + k] - alpha[:, -1, None]
                own = piece[:, i, : len(k)]
                hit = own >= 0
                kind = int(i > 0)
                if hit.any():
                    total[kind] += np.bincount(own[hit], (np.exp(logs) * share[:, None])[hit], minlength=self.sizes[kind])
        return total[0], total[1]


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(BASE) + ord(c) + 1) % 2**64
    return h


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points by row) of words of one length at a time."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, edges):
        if not len(group):
            continue
        width = int(size[group[0]])
        step = max(1, CHUNK // width)
        for i in range(0, len(group), step):
            at = group[i : i + step]
            text = "".join([words[j] for j in at])
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield at, codes.reshape(len(at), width).astype(np.uint64)


def vocabulary(path: str) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Start and inside pieces with starting log scores: by Zipf's law from their order in the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    starts, insides = {}, {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece, score = model.id_to_piece(i), 1 / (10 - model.get_score(i))
        into, piece = (starts, piece[1:]) if piece.startswith(START) else (insides, piece)
        if 0 < len(piece) <= LONGEST and START not in piece:
            into[piece] = max(score, into.get(piece, 0.0))
    out = []
    for found in (starts, insides):
        p = np.array(list(found.values()))
        out.append(np.log(p / p.sum()))
    return list(starts), list(insides), out[0], out[1]


def word_table(texts: DataFrame) -> DataFrame:
    """(word, c): every word of the texts, with its count in those that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for start, _, names, number, of in words_of(batch.column("text")):
                used = np.unique(number)
                n = np.bincount(number, weights=train[start + of], minlength=len(names)).astype(np.int64)
                yield pa.record_batch({"word": pa.array(names, pa.string()).take(pa.array(used)), "n": pa.array(n[used])})

    found = texts.select("text", "held_out").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


def fit(words: DataFrame, path: str, rounds: int) -> Lattice:
    """Piece scores from the training words by `rounds` of expectation maximisation.

    Each task returns one row for each piece it used; the driver sums them by piece, at
    most the vocabulary's size.
    """
    starts, insides, log_start, log_inside = vocabulary(path)
    lattice = Lattice(starts, insides, log_start, log_inside, 0.5)
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            total = [np.zeros(n) for n in own.sizes]
            for batch in batches:
                words = batch.column("word").to_pylist()
                for t, x in zip(total, own.expected(words, np.ones(len(words))), strict=True):
                    t += x
            every = np.concatenate(total)
            used = np.flatnonzero(every)
            yield pa.record_batch({"piece": pa.array(used, pa.int64()), "n": pa.array(every[used], pa.float64())})

        found = words.where("c > 0").select("word").mapInArrow(run, "piece bigint, n double")
        found = found.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        every = np.full(sum(lattice.sizes), 1e-3)
        every[found["piece"].to_numpy()] += found["n"].to_numpy()
        first, later = every[: lattice.sizes[0]], every[lattice.sizes[0] :]
        stop = min(max(first.sum() / every.sum(), 0.01), 0.99)
        lattice.set(np.log(first / first.sum()), np.log(later / later.sum()), float(stop))
    return lattice


def lm_scores(docs: DataFrame, path: str | None = None, rounds: int = 2, head: int = 131_072) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row."""
    path = path or public_tokenizers.path(PIECES)
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        (fold(F.col("doc_id"), 5) == 1).alias("held_out"),
    )
    ends = texts.where("not held_out").count()
    table = checkpoint(word_table(texts))
    sums = table.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = int(sums[0] or 0) + ends, int(sums[1] or 0) + (ends > 0)
    lattice = spark.sparkContext.broadcast(fit(table, path, rounds if n else 0))
    base_of = lambda c: (math.log10(c + 0.5) - math.log10(n + 0.5 * (v + 1)))
    spared = DISCOUNT * v / n if n else 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("c").to_numpy(zero_copy_only=False).astype(float)
            inside = lattice.value.log_probability(batch.column("word").to_pylist()) + math.log(spared)
            with np.errstate(divide="ignore"):
                p = np.logaddexp(inside, np.log(np.maximum(c - DISCOUNT, 0) / max(n, 1)))
            yield pa.record_batch({
                "word": batch.column("word"), "known": pa.array(c > 0, pa.bool_()),
                "base": pa.array(np.log10(c + 0.5) - math.log10(n + 0.5 * (v + 1)), pa.float64()),
                "model": pa.array(p / math.log(10), pa.float64()), "c": batch.column("c"),
            })

    scored = checkpoint(table.mapInArrow(score, "word string, known boolean, base double, model double, c bigint"))
    top = scored.orderBy(F.col("c").desc(), "word").limit(head).toArrow()  # `head` rows at most
    frequent = dict(zip(top["word"].to_pylist(), zip(top["known"].to_pylist(), top["base"].to_pylist(), top["model"].to_pylist(), strict=True), strict=True))
    frequent = spark.sparkContext.broadcast(frequent)
    end = (ends > 0, base_of(ends), math.log10((ends - DISCOUNT) / n) if ends else math.log10(0.5))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text: a row with the sums over frequent words, and a row for each other word."""
        of_word = frequent.value
        for batch in batches:
            for start, stop, names, number, of in words_of(batch.column("text")):
                entries = [of_word.get(w) for w in names]
                rare = np.fromiter((e is None for e in entries), dtype=bool, count=len(names))
                worth = np.array([e or (0, 0.0, 0.0) for e in entries], dtype=float).reshape(-1, 3)
                size = stop - start
                sums = [np.bincount(of, weights=x[number], minlength=size) for x in worth.T]
                own = batch.slice(start, size).select(["doc_id", "key", "held_out"])
                # No word holds a blank: this word is met by none, and spreads over all tasks.
                whole = [f" {key}" for key in own.column("key").to_pylist()]
                zero = np.zeros(size, dtype=np.int64)
                yield _parts(own, pa.array(whole, pa.string()), zero, np.bincount(of, minlength=size) + 1,
                             sums[0].astype(np.int64) + int(end[0]), sums[1] + end[1], sums[2] + end[2], zero + 1)
                at = np.flatnonzero(rare[number])
                pair, times = np.unique(of[at] * max(len(names), 1) + number[at], return_counts=True)
                text, word = pair // max(len(names), 1), pair % max(len(names), 1)
                zero, blank = np.zeros(len(pair), dtype=np.int64), np.zeros(len(pair))
                words = pa.array(names, pa.string()).take(pa.array(word))
                yield _parts(own.take(pa.array(text)), words, times, zero, zero, blank, blank, zero)

    parts = texts.withColumn("key", F.xxhash64("text")).mapInArrow(split, SCHEMA)
    found = parts.join(scored.select(F.col("word").alias("w"), "known", "base", "model"), F.col("word") == F.col("w"), "left")
    times = F.col("times")
    sums = found.groupBy("doc_id", "key", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + times * F.coalesce(F.col("known").cast("long"), F.lit(0))).alias("n_known"),
        F.sum(F.col("h_base") + times * F.coalesce("base", F.lit(0.0))).alias("base_score"),
        F.sum(F.col("h_model") + times * F.coalesce("model", F.lit(0.0))).alias("score"),
        F.sum("whole").alias("copies"),
    )
    # Repeated rows meet in one group: each takes its share again.
    share = {c: (F.col(c) / F.col("copies")).cast(kind).alias(c) for c, kind in
             {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}.items()}
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "held_out", share["n_tokens"], share["n_known"], F.lit(n).cast("bigint").alias("train_tokens"),
        share["base_score"], share["score"],
    )


SCHEMA = (
    "doc_id bigint, key bigint, held_out boolean, word string, times bigint, n_tokens bigint, n_known bigint,"
    " h_base double, h_model double, whole bigint"
)


def _parts(own: pa.RecordBatch, words: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
    names = ["times", "n_tokens", "n_known", "h_base", "h_model", "whole"]
    return pa.RecordBatch.from_arrays(
        [*own.columns, words, *map(pa.array, columns)], ["doc_id", "key", "held_out", "word", *names]
    )
