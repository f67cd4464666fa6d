"""Hard-negative mining by angular triangle filtering.

Each vector's angles to a few reference directions are stored with it. By the triangle
inequality the angle between two vectors lies between the largest difference and the
smallest sum of their angles to a reference; so their cosine lies in an interval which,
multiplied by both norms and widened by the rounding of all steps, bounds their integer
inner product. Only pairs whose interval overlaps the wanted window of scores are scored.

Vectors are ordered by label, nearest reference and the angle to it, and packed into blocks.
The anchors, packed as well, meet all blocks: first those of their own label, for the
positives (window: from the last of the best so far upwards), then those of other labels, for
the negatives (windows: the shares `low` to `high` of each positive's score). Blocks whose
boxes of angles and norms keep them outside every window don't meet; in a meeting, the same is
decided for stretches of rows, then for pairs. Each meeting hands on its best rows only.

The reference directions come from `sample` rows at most, each the one farthest from those
before it; they decide how much is skipped, never the result.

Defined cases: rows with a NULL label, a NULL vector or a NULL or non-finite component take
no part. A row without vec_id is no anchor, stands behind equal scores with one, and is given
with a NULL id. Repeated rows are rows of their own, as anchors too. Shorter vectors count as
filled with zeros. A vector of zeros has score 0 with all. An anchor without positives, or a positive
without negatives in its window, gives no row. An inner product beyond 64 bits is an error.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import checkpoint
from logweir.llm.vectors import kept_vectors, matrix, products

SCALE = 256
#: Windows of an anchor at most: as many as positives.
WANTS = 5
REFERENCES, SAMPLE = 8, 1024
#: Rows of a block of vectors and of a block of anchors, rows compared at once, blocks of anchors of a task.
BLOCK, ANCHORS, STRETCH, TOGETHER = 16_384, 512, 1024, 16
#: Radians by which stored angles (32-bit) and the arithmetic on them may be off.
SLACK = 2e-6
LEAST = np.iinfo(np.int64).min

PACKED = (
    "partition int, nth int, n int, label bigint, least array<float>, most array<float>, norm double, floor double,"
    " key array<bigint>, vec_id array<bigint>, vectors binary, width int, angles binary, wants binary"
)


def references(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit directions, each the farthest of the sample from those before it."""
    norm = np.linalg.norm(sample.astype(np.float64), axis=1)
    units = sample[norm > 0] / norm[norm > 0, None]
    if not len(units):
        return np.eye(1, max(sample.shape[1], 1))
    chosen, near = [units[0]], units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(units[int(np.argmin(near))])
        near = np.maximum(near, units @ chosen[-1])
    return np.array(chosen)


def angles_to(vectors: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angles, norms); a vector of zeros stands at right angles."""
    v = vectors.astype(np.float64)
    norm = np.linalg.norm(v, axis=1)
    cos = (v @ refs.T) / np.where(norm > 0, norm, 1)[:, None]
    return np.arccos(np.clip(cos, -1, 1)).astype(np.float32), norm


def placed(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """Add the nearest reference and the angle to it."""
    width = refs.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles, _ = angles_to(matrix(batch.column("v"), width), refs)
            near = angles.argmin(axis=1) if len(angles) else np.zeros(0, int)
            yield batch.append_column("near", pa.array(near, pa.int32())).append_column(
                "angle", pa.array(angles[np.arange(len(near)), near], pa.float32())
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, near int, angle float")


def packed(rows: DataFrame, refs: np.ndarray, size: int) -> DataFrame:
    """Blocks of at most `size` rows of one label, near to one another; a row of PACKED each, numbered from 0 by `block`.

    `rows` has key, vec_id, label, v and wants (array<bigint>).
    """
    width = refs.shape[1]

    def pack(rows: dict, nth: int, part: int) -> dict:
        vectors, wants = rows["v"], rows["wants"]
        angles, norms = angles_to(vectors, refs)
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.abs(vectors).max(initial=0) <= np.iinfo(k).max)
        return {
            "partition": part, "nth": nth, "n": len(vectors), "label": rows["label"], "least": angles.min(axis=0).tolist(),
            "most": angles.max(axis=0).tolist(), "norm": float(norms.max()), "floor": _floor(wants), "key": rows["key"], "vec_id": rows["vec_id"],
            "vectors": vectors.astype(kind).tobytes(), "width": np.dtype(kind).itemsize, "angles": angles.tobytes(), "wants": wants.tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal held, nth
            joined = {
                "label": held[0]["label"], **{c: sum((h[c] for h in held), []) for c in ("key", "vec_id")},
                **{c: np.concatenate([h[c] for h in held]) for c in ("v", "wants")},
            }
            out, held, nth = pack(joined, nth, part), [], nth + 1
            return pa.RecordBatch.from_pylist([out], schema=_arrow_schema())

        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(labels)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(labels)], strict=True):
                while a < b:
                    if held and (held[0]["label"] != labels[a] or sum(len(h["key"]) for h in held) >= size):
                        yield flush()
                    end = min(b, a + size - sum(len(h["key"]) for h in held))
                    own = batch.slice(a, end - a)
                    held.append({
                        "label": int(labels[a]), "key": own.column("key").to_pylist(), "vec_id": own.column("vec_id").to_pylist(),
                        "v": matrix(own.column("v"), width), "wants": matrix(own.column("wants"), WANTS),
                    })
                    a = end
        if held:
            yield flush()

    order = ["label", "near", "angle", "key"]
    near = placed(rows, refs).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "vec_id", "label", "v", "wants")
    blocks = checkpoint(near.mapInArrow(run, PACKED))
    # As many counts as there are partitions.
    counts = sorted((r[0], r[1]) for r in blocks.groupBy("partition").count().collect())
    before = np.cumsum([0, *[n for _, n in counts]])
    first = F.create_map(*[F.lit(x) for (p, _), b in zip(counts, before, strict=False) for x in (p, int(b))]) if counts else F.lit(None)
    return blocks.withColumn("block", (first[F.col("partition")] if counts else F.lit(0)) + F.col("nth"))


def _floor(wants: np.ndarray) -> float | None:
    """Where the lowest of the windows begins; None if there are none."""
    return float(_half(wants[wants >= 0].min())) if (wants >= 0).any() else None


def _half(score):
    return score // 2 + score % 2


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
             "array<float>": pa.list_(pa.float32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in PACKED.split(", "))])


class Block:
    """A packed block as matrices."""

    def __init__(self, row: dict):
        n = row["n"]
        self.label = row["label"]
        self.key = np.array([k if k is not None else LEAST for k in row["key"]], np.int64)
        self.vec_id = np.array([k if k is not None else 0 for k in row["vec_id"]], np.int64)
        self.no_id = np.array([k is None for k in row["vec_id"]], bool)
        self.vectors = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(n, -1).astype(np.int64)
        self.angles = np.frombuffer(row["angles"], np.float32).reshape(n, -1).astype(np.float64)
        self.norms = np.linalg.norm(self.vectors.astype(np.float64), axis=1)
        self.wants = np.frombuffer(row["wants"], np.int64).reshape(n, WANTS)


def _scores(low: np.ndarray, high: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores for angles of `low` to `high`, safe against rounding."""
    pad = norms * 1e-9 + 1
    return np.cos(np.minimum(high + SLACK, np.pi)) * norms - pad, np.cos(np.maximum(low - SLACK, 0)) * norms + pad


def pair_bounds(a: np.ndarray, a_norm: np.ndarray, b: np.ndarray, b_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of each pair, from angles to the references and norms."""
    low, high = np.zeros((len(a), len(b))), np.full((len(a), len(b)), np.pi)
    for r in range(a.shape[1]):
        x, y = a[:, r, None], b[None, :, r]
        np.maximum(low, np.abs(x - y), out=low)
        total = x + y
        np.minimum(high, np.minimum(total, 2 * np.pi - total), out=high)
    return _scores(low, high, a_norm[:, None] * b_norm[None, :])


def box_bounds(a: np.ndarray, a_norm: np.ndarray, least: np.ndarray, most: np.ndarray, norms: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of each anchor with any row of a box of angles and norms."""
    low = np.maximum(np.maximum(a - most, least - a), 0).max(axis=1)
    high = np.minimum(np.minimum(a + most, 2 * np.pi - (a + least)), np.pi).min(axis=1)
    bounds = [_scores(low, high, a_norm * n) for n in norms]
    return np.minimum(bounds[0][0], bounds[1][0]), np.maximum(bounds[0][1], bounds[1][1])


class Best:
    """The `k` best (score, then least id, rows without one last) of each of n queries."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows = [np.zeros(0, np.int64) for _ in range(5)]  # query, score, no id, id, same
        self.floor = np.full(n, LEAST)

    def add(self, query, score, no_id, ids, same) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, (query, score, no_id, ids, same), strict=True)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        start = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        full = place == self.k - 1
        self.floor[rows[0][full]] = rows[1][full]
        self.rows = [r[place < self.k] for r in rows]


def meet(anchors: Block, block: Block, k: int) -> Best:
    """The best rows of `block` for each window of each anchor; without windows, for each anchor.

    Query q of an anchor i has number i * windows + q.
    """
    windows = _windows(anchors)
    per = windows[0].shape[1]
    best = Best(len(anchors.key) * per, k)
    for at in range(0, len(block.key), STRETCH):
        rows = slice(at, at + STRETCH)
        low = np.maximum(windows[0], best.floor.reshape(-1, per))  # what is below the last of the best is not wanted
        norms = block.norms[rows]
        box = box_bounds(anchors.angles, anchors.norms, block.angles[rows].min(axis=0), block.angles[rows].max(axis=0), (norms.min(), norms.max()))
        hit = np.flatnonzero(((box[1][:, None] >= low) & (box[0][:, None] <= windows[1])).any(axis=1))
        if not len(hit):
            continue
        least, most = pair_bounds(anchors.angles[hit], anchors.norms[hit], block.angles[rows], norms)
        ok = [(most >= low[hit, q, None]) & (least <= windows[1][hit, q, None]) for q in range(per)]
        wanted = np.logical_or.reduce(ok)
        own, other = hit[wanted.any(axis=1)], at + np.flatnonzero(wanted.any(axis=0))
        if not len(own):
            continue
        score = products(anchors.vectors[own], block.vectors[other])
        pair = wanted[np.ix_(np.searchsorted(hit, own), other - at)]
        for q in range(per):
            inside = pair & (score >= low[own, q, None]) & (score <= windows[1][own, q, None])
            if inside.shape[1] > k:
                held = np.where(inside, score, LEAST)
                inside &= held >= -np.partition(-held.astype(np.float64), k - 1, axis=1)[:, k - 1, None]
            i, j = np.nonzero(inside)
            if len(i):
                a, b = own[i], other[j]
                same = (score[i, j] == _square(anchors, a)) & (score[i, j] == _square(block, b)) & (
                    anchors.vec_id[a] == block.vec_id[b]) & ~block.no_id[b]
                best.add(a * per + q, score[i, j], block.no_id[b].astype(np.int64), block.vec_id[b], same.astype(np.int64))
    return best


def _square(block: Block, rows: np.ndarray) -> np.ndarray:
    v = block.vectors[rows]
    return (v * v).sum(axis=1)


def _windows(anchors: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest wanted score of each anchor's windows; `wants` holds positives' scores, or -1, or -2 for all scores."""
    w = anchors.wants
    if len(w) and w[0, 0] == -2:
        return np.full((len(w), 1), LEAST), np.full((len(w), 1), np.inf)
    low, high = _half(w), w - (w + 19) // 20
    return np.where(w >= 0, low, np.iinfo(np.int64).max), np.where(w >= 0, high, LEAST)


def meetings(anchors: DataFrame, blocks: DataFrame, together: Column) -> DataFrame:
    """(block, part, a_block): the pairs of blocks that have to meet.

    Each block of anchors is paired with the number of each block of rows; only boxes travel.
    """
    total = blocks.count()
    numbers = F.explode(F.sequence(F.lit(0), F.lit(total - 1))) if total else F.explode(F.array().cast("array<int>"))
    a = anchors.select(
        F.col("block").alias("a_block"), F.col("label").alias("a_label"), F.col("least").alias("a_least"), F.col("most").alias("a_most"),
        F.col("norm").alias("a_norm"), "floor", numbers.alias("number"),
    )
    b = blocks.select("block", "label", "least", "most", "norm")
    # The least angle between any two vectors of both boxes.
    gaps = F.zip_with(
        F.zip_with("a_least", "most", lambda x, y: x - y), F.zip_with("least", "a_most", lambda x, y: x - y), lambda x, y: F.greatest(x, y)
    )
    apart = F.greatest(F.array_max(gaps).cast("double") - F.lit(SLACK), F.lit(0.0))
    scale = F.col("a_norm") * F.col("norm")
    # The largest norms bound a positive score only; below, nothing is left out.
    reach = F.when(F.cos(apart) > 0, F.cos(apart) * scale).otherwise(F.lit(0.0)) + scale * F.lit(1e-9) + F.lit(1.0)
    pairs = a.join(b, F.col("number") == F.col("block")).where(together & (F.col("floor").isNull() | (reach >= F.col("floor"))))
    return pairs.select("block", F.floor(F.col("a_block") / TOGETHER).cast("int").alias("part"), "a_block")


def searched(anchors: DataFrame, blocks: DataFrame, together: Column, k: int) -> DataFrame:
    """(a, want, score, id, same): the best `k` of each meeting, for each anchor `a` and window."""
    data = ["n", "label", "key", "vec_id", "vectors", "width", "angles", "wants"]
    pairs = checkpoint(meetings(anchors, blocks, together))
    left = anchors.select(F.col("block").alias("number"), *data)
    left = pairs.join(left, F.col("a_block") == F.col("number")).select("block", "part", *data)
    right = blocks.select(F.col("block").alias("number"), *data)
    groups = pairs.select(F.col("block").alias("r_block"), F.col("part").alias("r_part")).distinct()
    right = groups.join(right, F.col("r_block") == F.col("number")).select("r_block", "r_part", *data)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {c: [] for c in ("a", "want", "score", "id", "same")}
        for other in right.to_pylist():
            block = Block(other)
            for own in left.to_pylist():
                mine = Block(own)
                best = meet(mine, block, k)
                query, score, no_id, ids, same = best.rows
                per = _windows(mine)[0].shape[1]
                want = mine.wants[query // per, query % per]
                for c, values in zip(rows, (mine.key[query // per], want, score, pa.array(ids, mask=no_id.astype(bool)), same == 1), strict=True):
                    rows[c].append(pa.array(values))
        kinds = {"a": pa.int64(), "want": pa.int64(), "score": pa.int64(), "id": pa.int64(), "same": pa.bool_()}
        return pa.table({c: pa.chunked_array(v, kinds[c]) for c, v in rows.items()})

    found = left.groupBy("block", "part").cogroup(right.groupBy("r_block", "r_part")).applyInArrow(
        run, "a bigint, want bigint, score bigint, id bigint, same boolean"
    )
    order = [F.desc("score"), F.asc_nulls_last("id"), F.desc("same")]
    in_query = Window.partitionBy("a", "want").orderBy(*order)
    return found.withColumn("place", F.row_number().over(in_query)).where(F.col("place") <= k)


def hard_negatives(
    rows: DataFrame, every: int = 50, shift_every: int = 7, positives: int = 5, negatives: int = 3, block: int = BLOCK,
    anchor_block: int = ANCHORS, n_references: int = REFERENCES, sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's hard negatives."""
    if not 1 <= positives <= WANTS:
        raise ValueError(f"positives must be 1 to {WANTS}")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % shift_every == 0, (label + 1) % 10).otherwise(label)
    kept = kept_vectors(rows.where("label is not null"), SCALE).withColumn("label", moved)
    # Numbered and stored, so that a row keeps its number.
    kept = checkpoint(kept.withColumn("key", F.monotonically_increasing_id()))
    width = int(kept.agg(F.max(F.size("v"))).first()[0] or 1)
    few = kept.orderBy(F.xxhash64("vec_id"), "key").limit(sample).select("v").toArrow()
    refs = references(matrix(few.column("v").combine_chunks(), width), n_references)

    nothing = F.array_repeat(F.lit(-1).cast("bigint"), WANTS)
    blocks = packed(kept.withColumn("wants", nothing), refs, block)
    anchors = kept.where(F.col("vec_id") % every == 0)
    asking = packed(anchors.withColumn("wants", F.array_repeat(F.lit(-2).cast("bigint"), WANTS)), refs, anchor_block)
    best = searched(asking, blocks, F.col("a_label") == F.col("label"), positives + 1)
    # One of the rows found may be the anchor itself, which is taken out.
    first = F.array_sort(F.collect_list(F.struct("place", "score", "id", "same"))).alias("best")
    lists = best.groupBy("a").agg(first).withColumn(
        "self", F.coalesce(F.array_min(F.filter(F.transform("best", lambda x: F.when(x.same, x.place)), lambda x: x.isNotNull())), F.lit(0))
    )
    others = F.slice(F.filter("best", lambda x: x.place != F.col("self")), 1, positives)
    positive = checkpoint(lists.select("a", F.explode(others).alias("p")).select(
        "a", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")
    ))

    scores = positive.where("positive_score >= 0").groupBy("a").agg(F.collect_set("positive_score").alias("s"))
    wants = F.concat("s", F.array_repeat(F.lit(-1).cast("bigint"), F.lit(WANTS) - F.size("s")))
    wanting = anchors.join(scores, F.col("key") == F.col("a")).withColumn("wants", wants)
    asking = packed(wanting.select("key", "vec_id", "label", "v", "wants"), refs, anchor_block)
    found = searched(asking, blocks, F.col("a_label") != F.col("label"), negatives)
    ids = anchors.select(F.col("key").alias("a_key"), F.col("vec_id").alias("anchor_id"))
    negative = found.select(F.col("a").alias("n_a"), "want", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positive.join(ids, F.col("a") == F.col("a_key")).join(
        negative, (F.col("a") == F.col("n_a")) & (F.col("positive_score") == F.col("want"))
    )
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
