"""Vector code compression: product codes from integer k-means over Hilbert-sorted blocks.

Each vector is cut into `PARTS` equal parts, each with a codebook of 256 entries, which start
as the parts of the rows with the least ids and are moved by rounds of assignment and mean.

The parts of all rows are ordered along a Hilbert curve of their position and packed into flat
blocks, each with the box (least and most) and the sum of its parts. In every round the squared
distances of a block's box to an entry, from its nearest and to its farthest corner, leave a
shortlist: an entry whose nearest is beyond another's farthest can be nobody's nearest. If one
entry is left, the whole block goes to it by its sum; else a small integer kernel compares the
block's parts with the shortlist only. Tasks add up sums and counts per entry before they are
shuffled; codebooks (PARTS x 256 entries, a fixed size) are all that goes through the driver.

All arithmetic is on integers: distances by expanded squares in 64-bit floats while these are
exact, else by differences in 64-bit integers.

Defined cases: rows with a NULL vector or a NULL or non-finite component are dropped. NULL ids
come last among the least ids; ties of ids are settled by components. With fewer than 256 rows the codebook has as
many entries as rows. Vectors shorter than the longest, or whose length is no multiple of the
parts, count as filled with zeros. Repeated rows stay, each with its code. NULL labels share
one label_error. Components whose squared distances exceed 64 bits are an error. An empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import checkpoint
from logweir.llm.vectors import EXACT_FLOAT, EXACT_LONG, kept_vectors, matrix

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts of a block, and bits of each component that order them.
BLOCK, CURVE_BITS = 256, 8

PACKED = "part int, n int, ids array<bigint>, least array<bigint>, most array<bigint>, total array<bigint>, parts binary"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Sortable bytes: the place of each point, of components within [0, 2^bits), on a Hilbert curve.

    The transposed form of the curve's index is found bit by bit for all points at once
    (J. Skilling, Programming the Hilbert curve, AIP 2004), then its bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = high
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    order = np.array([(x >> b) & 1 for b in range(bits - 1, -1, -1)], np.uint8)  # bit, dimension, point
    return np.packbits(order.reshape(bits * dims, -1).T, axis=1)


def blocks_of(rows: DataFrame, width: int, least: int, most: int) -> DataFrame:
    """PACKED blocks of the parts of rows (id, v) with components from `least` to `most`."""
    per = width // PARTS
    shift = max((most - least).bit_length() - CURVE_BITS, 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            for p in range(PARTS):
                own = v[:, p * per : (p + 1) * per]
                keys = hilbert_keys((own - least) >> shift, CURVE_BITS) if len(own) else own.astype(np.uint8)
                yield pa.record_batch({
                    "part": pa.array(np.full(len(own), p), pa.int32()), "curve": pa.array([k.tobytes() for k in keys], pa.binary()),
                    "id": batch.column("id"), "v": pa.array([r.tobytes() for r in own.astype(np.int64)], pa.binary()),
                })

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, held = None, [], []
        for batch in batches:  # ordered by part and curve
            for p, i, v in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "v")), strict=True):
                if held and (p != part or len(held) == BLOCK):
                    yield _block(part, ids, held, per)
                    ids, held = [], []
                part = p
                ids.append(i)
                held.append(v)
        if held:
            yield _block(part, ids, held, per)

    parts = rows.mapInArrow(cut, "part int, curve binary, id bigint, v binary")
    ordered = parts.repartitionByRange("part", "curve", "id").sortWithinPartitions("part", "curve", "id")
    return ordered.select("part", "id", "v").mapInArrow(pack, PACKED)


def _block(part: int, ids: list[int], held: list[bytes], per: int) -> pa.RecordBatch:
    v = np.frombuffer(b"".join(held), np.int64).reshape(len(held), per)
    longs = pa.list_(pa.int64())
    return pa.record_batch({
        "part": pa.array([part], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids], longs),
        "least": pa.array([v.min(axis=0)], longs), "most": pa.array([v.max(axis=0)], longs), "total": pa.array([v.sum(axis=0)], longs),
        "parts": pa.array([v.astype(_width(v)).tobytes()], pa.binary()),
    })


def _width(v: np.ndarray) -> np.dtype:
    """The narrowest type of integers that holds all of `v`."""
    size = np.abs(v).max(initial=0)
    return next(np.dtype(k) for k in (np.int16, np.int32, np.int64) if size <= np.iinfo(k).max)


def _points(row: dict) -> np.ndarray:
    width = len(row["parts"]) // (row["n"] * len(row["least"]))
    return np.frombuffer(row["parts"], f"i{width}").reshape(row["n"], -1).astype(np.int64)


def shortlist(least: np.ndarray, most: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entries, ascending, that can be nearest to some point of a box."""
    near = np.maximum(np.maximum(least - book, book - most), 0)
    far = np.maximum(np.abs(least - book), np.abs(most - book))
    near, far = (near * near).sum(axis=1), (far * far).sum(axis=1)
    return np.flatnonzero(near <= far.min())


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `book` of the nearest entry, the lower of equals; squared distance) of each point."""
    size = max(np.abs(points).max(initial=0), np.abs(book).max(initial=0))
    if 4 * int(size) ** 2 * max(points.shape[1], 1) < EXACT_FLOAT:
        p, b = points.astype(np.float64), book.astype(np.float64)
        far = (b * b).sum(axis=1) - 2 * (p @ b.T)
        at = far.argmin(axis=1)
        return at, (far[np.arange(len(p)), at] + (p * p).sum(axis=1)).astype(np.int64)
    at, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
    for k, entry in enumerate(book):
        d = ((points - entry) ** 2).sum(axis=1)
        closer = d < best
        at[closer], best[closer] = k, d[closer]
    return at, best


def round_sums(blocks: DataFrame, books: np.ndarray) -> list:
    """Rows (part, entry, n, sums) of one assignment of all parts; entries without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(books.shape[:2], np.int64)
        sums = np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                part, book = row["part"], books[row["part"]]
                few = shortlist(np.array(row["least"]), np.array(row["most"]), book)
                if len(few) == 1:  # the block as a whole
                    counts[part, few[0]] += row["n"]
                    sums[part, few[0]] += np.array(row["total"])
                    continue
                points = _points(row)
                at, _ = nearest(points, book[few])
                counts[part, few] += np.bincount(at, minlength=len(few))
                np.add.at(sums[part], few[at], points)
        part, entry = np.nonzero(counts)
        yield pa.record_batch({
            "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(counts[part, entry]),
            "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
        })

    per = books.shape[2]
    rows = blocks.select("part", "n", "least", "most", "total", "parts").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(per)]
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()  # PARTS * ENTRIES rows at most


def moved(books: np.ndarray, rows: list) -> np.ndarray:
    """Each entry at the mean of its parts, down to integers; entries without parts stay."""
    out = books.copy()
    for part, entry, n, *sums in rows:
        out[part, entry] = [s // n for s in sums]
    return out


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, part, entry, far) of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                book = books[row["part"]]
                few = shortlist(np.array(row["least"]), np.array(row["most"]), book)
                points = _points(row)
                at, far = nearest(points, book[few])
                yield pa.record_batch({
                    "id": pa.array(row["ids"], pa.int64()), "part": pa.array(np.full(row["n"], row["part"]), pa.int32()),
                    "entry": pa.array(few[at], pa.int32()), "far": pa.array(far, pa.int64()),
                })

    return blocks.select("part", "n", "ids", "least", "most", "parts").mapInArrow(run, "id bigint, part int, entry int, far bigint")


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def trained(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        books = moved(books, round_sums(blocks, books))
    return books


def vector_codes(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row with a sound vector."""
    kept = checkpoint(kept_vectors(rows, SCALE).withColumn("id", F.monotonically_increasing_id()))
    size, least, most = kept.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    least, most = min(least or 0, 0), max(most or 0, 0)
    width = -(-max(size or 0, 1) // PARTS) * PARTS
    if 4 * max(-least, most) ** 2 * (width // PARTS) >= EXACT_LONG:
        raise ValueError(f"squared distances of components of {least} to {most} do not fit 64 bits")
    # A codebook's worth of rows, whatever the table's size.
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    start = matrix(first.column("v").combine_chunks(), width)
    books = start.reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2)
    blocks = checkpoint(blocks_of(kept.select("id", "v"), width, least, most))
    if len(start):
        books = trained(blocks, np.ascontiguousarray(books), rounds)
    codes = assigned(blocks, books).groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda x: F.lpad(F.lower(F.hex(x.entry)), 2, "0")), "").alias("code"),
        F.sum("far").alias("error"),
    ).withColumnRenamed("id", "c_id")
    coded = checkpoint(kept.select("id", "vec_id", "label").join(codes, F.col("id") == F.col("c_id")).select("vec_id", "label", "code", "error"))
    sums = coded.groupBy(F.col("label").alias("l_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("l_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
