"""Byte-level BPE encoding and decoding by a tree of segments.

Encoding is a reduction over halves: a long text is cut in the middle, both halves are
encoded, and neighbours are joined by encoding a window around their boundary anew. The
window grows on either side until tokens outside it are provably final: at a place where
white space follows a character that is none, the pattern has a match boundary in every
context (no match holds white space behind a character that is none), so what lies left
of it is encoded as if it stood alone, and what lies right of it as well. A half without
such a place is taken into the window whole, so that the result is exact in any case.
Leaves are encoded by the tiktoken library with the given ranks. Decoding looks up the
bytes of each token and concatenates halves up the same kind of tree.

The encoding of a text is one Spark row's work; rows are spread by Spark. A rank file is
read by path on each worker (a parameter, part of an installed library) and kept there.

Defined cases: a NULL text is an empty one (no tokens). Marks of special tokens in a text
are ordinary text. Repeated rows and NULL ids are encoded like any other row. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a leaf, and of the first window on either side of a boundary.
LEAF, WINDOW = 8192, 32
LEAF_IDS = 65_536


class Codec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._leaf = leaf
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self.digits = [str(i) for i in range(len(self._bytes))]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self._leaf:
            return self._encode(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self._join(left, self.encode(left), right, self.encode(right))

    def _join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The tokens of left + right from those of its halves."""
        cut, end = _last_boundary(left), _first_boundary(right)
        tail, head = left[cut:], right[:end]
        stay = len(a) - len(self._encode(tail))
        return a[:stay] + self._encode(tail + head) + b[len(self._encode(head)) :]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self._bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _is_boundary(text: str, at: int) -> bool:
    """White space stands at `at`, behind a visible ASCII character or a letter."""
    before = text[at - 1]
    return text[at] in " \n" and ("!" <= before <= "~" or before.isalpha())


def _last_boundary(text: str) -> int:
    """The last certain match boundary, sought in growing windows; 0 if there is none."""
    size, seen = WINDOW, len(text)
    while seen > 1:
        low = max(1, len(text) - size)
        for at in range(seen - 1, low - 1, -1):
            if _is_boundary(text, at):
                return at
        seen, size = low, 2 * size
    return 0


def _first_boundary(text: str) -> int:
    size, seen = WINDOW, 1
    while seen < len(text):
        high = min(len(text), size)
        for at in range(seen, high):
            if _is_boundary(text, at):
                return at
        seen, size = max(seen, high), 2 * size
    return len(text)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each rank file and worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row's text."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [codec(path).encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return _texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and bytes (binary) of each row's ids."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [codec(path).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "bytes": pa.array(own, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode each text in one pass: number and digest of its ids, digest of the decoded bytes."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column("text"):  # one at a time: ids of a whole batch would not fit
                ids = own.encode(text.as_py())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(own.digits.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string()),
            })

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
