"""N-gram Jaccard join by parity sketches.

A document is the set of hashes of its word shingles. XOR-hashing the set into bits gives
a parity sketch: two sketches differ in at most as many bits as the sets have elements of
only one of them. Two sets of at most m elements with a Jaccard index of at least t differ
in at most d = (1 - t) / (1 + t) * 2m elements. So, for each band of sizes, the sketch is
cut into more than d segments: of a linked pair at least one segment is equal in both
(pigeonhole).

Equal sets are one class from the start. Where classes share a segment, short sketches
bound their differences from below, and pairs beyond d are left out; what remains is closed
into groups, and a group is verified in blocks: inside a task, longer sketches bound the
difference of each pair first, then the sets are compared exactly; pairs known to be
connected are skipped, and a task returns a spanning forest of its links, never all pairs.
Groups of any size are split
into blocks of `block` classes, and blocks meet in pairs of the same or neighbouring size
bands, so no group is one task and no link is lost. Links are closed into components.

Segments without a bit are light: many texts share them by chance. There are `light` +
`common` segments beyond d + 1, so more than so many segments of a linked pair are equal,
and a document with at most `light` light ones needn't hand these on; one with more does.
Equal segments are light in both documents or in neither, so no pair is lost. Of the others
each class leaves out its `common` ones that most classes share, as a passage of many texts
makes: all go by one order, so the rarest that a pair shares is left to both. Linked classes
share many segments; of those with the same classes one is left before sketches join them.
Segments travel packed, a row for each bucket of keys and not for each segment.

Classes are told apart by 64-bit hashes of their sets (a chance of n^2 / 2^65 that any two
of n classes are mixed up).

Defined cases: a text without words, or NULL, has an empty set, is linked with nothing and
is its own component. A text shorter than a shingle is one shingle. Repeated rows are in
one component, each with its own row. A NULL id has component_id NULL unless it is linked
with a row that has an id. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import checkpoint, has_word, release

#: The settings of the query; callers give their own.
SHINGLE = 4
PERCENT = 85
#: Bands of sizes grow by half; linked sets are of the same or of neighbouring bands from 67 % on.
GROWTH, LEAST_PERCENT = 1.5, 67
SEGMENT_BITS, SKETCH_BITS = 65_536, 4096
#: The last bits of a segment's key tell its band; there can't be as many bands.
BANDS = 64
#: Keys are dealt to buckets of about so many; a row of a bucket holds the last bytes of its keys and their classes.
BUCKET, MOST_BUCKETS, KEPT_BYTES = 200_000, 1 << 15, 6
#: Keys that a task holds before it hands them on.
MOST_HELD = 500_000
#: Bits of a short sketch: as many as elements, rounded up to a power of two within these.
LEAST_BITS, MOST_BITS = 256, 16_384
#: Classes of one segment that a task compares; of more, all are left to the blocks.
MOST = 20_000
#: Parts that the rows of a component of more than LARGE rows are dealt to.
SALTS, LARGE = 32, 1000
#: Texts that are cut into words at once.
SLICE = 500


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `shingle` words."""
    for start in range(0, len(texts), SLICE):
        # Both kernels are about ASCII only: A-Z, and the blanks 9 to 13 and 32.
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(start, SLICE)))
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))
        real = np.fromiter((w != "" for w in names), dtype=bool, count=len(names))
        place = words.indices.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        kept = real[place] if len(place) else np.zeros(0, bool)
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        h = hashes[place[kept]]
        every = np.zeros(max(len(h) - shingle + 1, 0), dtype=np.uint64)
        for k in range(shingle):
            every = _mixed(every + h[k : len(h) - shingle + 1 + k] + np.uint64(k + 1)) if len(every) else every
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= shingle:
                yield np.unique(every[a : b - shingle + 1])
            elif b > a:
                yield np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), 1)], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - 2**63


def band_edges(longest: int, percent: int = PERCENT) -> list[int]:
    # Below the second edge linked sets are equal: a set short of one element of m has (m - 1) / m of it.
    edges = [1, ceil(100 / (100 - percent))]
    while edges[-1] <= longest:
        edges.append(ceil(edges[-1] * GROWTH))
    return edges


def segments(band_end: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(segments, light, common) for sets of fewer than `band_end` elements: so many light and common ones can be spared."""
    differ = 2 * (band_end - 1) * (100 - percent) // (100 + percent)
    light, common = 2 + (differ + 1) // 14, 2 + (differ + 1) // 5
    return differ + 1 + light + common, light, common


def segment_keys(shingles: np.ndarray, edges: list[int], percent: int = PERCENT) -> Iterator[np.ndarray]:
    """Keys of the sketch's segments for each band in which the set may meet a partner of at least its size."""
    n = len(shingles)
    for band, (low, high) in enumerate(zip(edges[1:-1], edges[2:], strict=True)):  # in the first band linked sets are equal
        if not (n < high and 100 * n >= percent * low):
            continue
        count, spare, _ = segments(high, percent)
        segment = (shingles >> np.uint64(32)) % np.uint64(count)
        bits, times = np.unique(segment * np.uint64(SEGMENT_BITS) + shingles % np.uint64(SEGMENT_BITS), return_counts=True)
        bits = bits[times % 2 == 1]  # XOR clears what is set twice
        of = (bits // np.uint64(SEGMENT_BITS)).astype(np.int64)
        weight = np.bincount(of, minlength=count)
        keys = np.zeros(count, dtype=np.uint64)
        if len(of):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            keys[of[first]] = np.bitwise_xor.reduceat(_mixed(bits + np.uint64(1)), first)
        light = weight < 1
        name = np.flatnonzero(~light) if light.sum() <= spare else np.arange(count)
        keys, name = keys[name], name.astype(np.uint64)
        keys = _mixed(keys ^ _mixed(np.uint64(high) * np.uint64(1 << 24) + name))
        yield (keys // np.uint64(BANDS) * np.uint64(BANDS) + np.uint64(band)).view(np.int64)


def classes(texts: DataFrame, shingle: int) -> DataFrame:
    """doc_id, content, n_shingles, class and short sketch of each row; class is NULL for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(len(s), class_of(s) if len(s) else None, _short(s).tobytes()) for s in shingle_sets(batch.column("text"), shingle)]
            n, names, sketches = zip(*own, strict=True) if own else ((), (), ())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "content": batch.column("content"), "n_shingles": pa.array(n, pa.int64()),
                "class": pa.array(names, pa.int64()), "sketch": pa.array(sketches, pa.binary()),
            })

    return texts.mapInArrow(run, "doc_id bigint, content bigint, n_shingles bigint, class bigint, sketch binary")


def meetings(texts: DataFrame, longest: int, words: int, shingle: int, percent: int) -> DataFrame:
    """(key, class): the classes of the segments that at least two classes share, without each class's commonest ones.

    A linked pair shares more segments than a class leaves out. All classes leave out by one order of
    the segments, so the rarest of those that a pair shares is left to both. Classes are given by
    their last bits. `words` is about the number of shingles of all texts.
    """
    edges = band_edges(longest, percent)
    buckets = min(MOST_BUCKETS, words // BUCKET + 1)
    most = max(MOST_HELD, 64 * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task hand their segments on once
        keys, names, sizes, held = [], [], [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text"), shingle):
                if not len(s) or (name := class_of(s)) in seen:
                    continue
                seen.add(name)
                for own in segment_keys(s, edges, percent):
                    keys.append(own)
                    names.append(name)
                    sizes.append(len(own))
                    held += len(own)
                if held > most:
                    yield _packed(keys, names, sizes, buckets)
                    keys, names, sizes, held = [], [], [], 0
        if held:
            yield _packed(keys, names, sizes, buckets)

    rows = texts.select("text").mapInArrow(run, "bucket bigint, keys binary, classes binary")
    rows = rows.groupBy("bucket").applyInArrow(_shared, "key bigint, class bigint, n bigint")
    band = F.col("key").bitwiseAND(F.lit(BANDS - 1)).cast("int")
    common = F.lit([0, *(segments(high, percent)[2] for high in edges[2:])])  # one more, as there may be no band
    place = F.row_number().over(Window.partitionBy("class", band).orderBy(F.desc("n"), "key"))
    return rows.withColumn("place", place).where(F.col("place") > F.get(common, band + 1)).select("key", "class")


def _packed(keys: list[np.ndarray], names: list[int], sizes: list[int], buckets: int) -> pa.RecordBatch:
    """A row for each bucket, with the last `KEPT_BYTES` bytes of its keys and of their classes."""
    key, name = np.concatenate(keys).view(np.uint64), np.repeat(np.array(names, np.int64).view(np.uint64), sizes)
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket)
    own, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    packed = [x[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes() for x in (key, name)]
    cut = [[x[a * KEPT_BYTES : b * KEPT_BYTES] for a, b in zip(first.tolist(), ends, strict=True)] for x in packed]
    return pa.record_batch({"bucket": pa.array(own.astype(np.int64)), "keys": pa.array(cut[0], pa.binary()), "classes": pa.array(cut[1], pa.binary())})


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    kept = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, KEPT_BYTES)
    out = np.zeros((len(kept), 8), np.uint8)
    out[:, :KEPT_BYTES] = kept
    return out.view("<i8").ravel()


def _shared(rows: pa.Table) -> pa.Table:
    """(key, class, n) of the bucket's keys that n classes share, two at least."""
    key, name = _unpacked(rows["keys"]), _unpacked(rows["classes"])
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    fresh = new_key | np.concatenate([[True], name[1:] != name[:-1]])  # a copy that another task handed on goes
    key, name, new_key = key[fresh], name[fresh], new_key[fresh]
    n = np.diff(np.append(np.flatnonzero(new_key), len(key)))
    n = np.repeat(n, n)
    met = n > 1
    return pa.table({"key": key[met] + (rows["bucket"][0].as_py() << (8 * KEPT_BYTES)), "class": name[met], "n": n[met]})


def told_apart(met: DataFrame) -> DataFrame:
    """(key, class) without the segments whose classes are those of another segment.

    Sets of classes are told apart by two 64-bit sums that don't depend on order.
    """
    sums = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"sum{k}") for k in (1, 2)]
    sets = met.groupBy("key").agg(*sums, F.count(F.lit(1)).alias("n")).where("n > 1")
    one = sets.groupBy("sum1", "sum2", "n").agg(F.min("key").alias("one"))
    return met.join(one, F.col("key") == F.col("one"), "left_semi")


def candidates(met: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): what connects the classes of a segment whose sketches are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sizes, bits, first = None, [], [], [], None
        for batch in batches:  # sorted by key: a segment is a run of rows
            found: list[tuple[int, int]] = []
            for row_key, name, n, sketch in zip(*(batch.column(c).to_pylist() for c in ("key", "class", "n", "sketch")), strict=True):
                if row_key != key:
                    found += near(names, sizes, bits, percent)
                    key, names, sizes, bits, first = row_key, [], [], [], None
                if first is None and len(names) < MOST:
                    names.append(name)
                    sizes.append(n)
                    bits.append(sketch)
                else:  # too many to compare here: all stay candidates of the first
                    first = names[0] if first is None else first
                    found += [(first, other) for other in [*names[1:], name]]
                    names, sizes, bits = [], [], []
            yield _edges(found)
        yield _edges(near(names, sizes, bits, percent))

    short = F.col("class").bitwiseAND(F.lit((1 << (8 * KEPT_BYTES)) - 1))
    known = sketches.select(short.alias("k"), F.col("class").alias("name"), F.col("n_shingles").cast("int").alias("n"), "sketch")
    rows = met.join(known, F.col("class") == F.col("k")).select("key", F.col("name").alias("class"), "n", "sketch")
    # By the key itself Spark would leave this exchange out behind a join by key, and then might not keep that join's rows by key.
    return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def near(names: list[int], sizes: list[int], bits: list[bytes], percent: int) -> list[tuple[int, int]]:
    """What connects the pairs whose sketches and sizes allow a link."""
    if len(names) < 2:
        return []
    n = np.array(sizes)
    least = min(map(len, bits))
    # A sketch folds into a shorter one, as its bits are remainders by powers of two.
    sketches = np.array([np.bitwise_xor.reduce(np.frombuffer(b, dtype=np.uint64).reshape(-1, least // 8), axis=0) for b in bits])
    root = np.arange(len(names))
    for i in range(len(names) - 1):
        others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if not len(others):
            continue
        apart = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        apart = np.maximum(apart, np.abs(n[others] - n[i]))
        for j in others[(100 + percent) * apart <= (100 - percent) * (n[i] + n[others])]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
    return _stars(names, root)


def _stars(names: list[int], root: np.ndarray) -> list[tuple[int, int]]:
    """Each connected set as a star around its least name, which labels settle on at once."""
    least: dict[int, int] = {}
    for name, r in zip(names, root.tolist(), strict=True):
        least[r] = min(name, least.get(r, name))
    return [(least[r], name) for name, r in zip(names, root.tolist(), strict=True) if name != least[r]]


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable by the edges (a, b), of all nodes that have any.

    Each round takes the least label among neighbours, then the label's own label, which
    halves distances; it ends when no label changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("was")
        )
        of = labels.select(F.col("node").alias("root"), F.col("component").alias("of_root"))
        fresh = lower.join(of, F.col("component") == F.col("root")).select(
            "node", F.least("component", "of_root").alias("component"), "was"
        )
        fresh = checkpoint(fresh)
        labels = fresh.select("node", "component")
        if fresh.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def blocked(grouped: DataFrame, block: int, longest: int, percent: int) -> DataFrame:
    """Add `pair`, the block pairs that each class (doc_id, content, class, n_shingles, component) takes part in."""
    edges = F.lit(band_edges(longest, percent))
    band = F.size(F.filter(edges, lambda e: e <= F.col("n_shingles")))
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members")).withColumnRenamed("component", "s_component")
    rows = grouped.join(sizes, F.col("component") == F.col("s_component")).drop("s_component")
    # A group that fits one block needs no bands.
    rows = rows.withColumn("band", F.when(F.col("members") <= block, F.lit(0)).otherwise(band))
    parts = rows.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    at = lambda name, shift: parts.select(
        F.col("component").alias(f"{name}_c"), (F.col("band") + shift).alias(f"{name}_b"), F.col("parts").alias(name)
    )
    for name, shift in (("own", 0), ("below", 1), ("above", -1)):
        other = at(name, shift)
        rows = rows.join(other, (F.col("component") == F.col(f"{name}_c")) & (F.col("band") == F.col(f"{name}_b")), "left").drop(
            f"{name}_c", f"{name}_b"
        )
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class"), F.col("own")).cast("int"))
    up_to = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda lower, x, y: F.struct(lower.alias("band"), x.alias("x"), y.alias("y"))
    same = F.transform(up_to(F.col("own")), lambda p: pair(F.col("band") * 2, F.least(p, "part"), F.greatest(p, "part")))
    below = F.transform(up_to(F.col("below")), lambda p: pair(F.col("band") * 2 - 1, p, F.col("part")))
    above = F.transform(up_to(F.col("above")), lambda p: pair(F.col("band") * 2 + 1, F.col("part"), p))
    rows = rows.withColumn("pair", F.explode(F.concat(same, below, above)))
    return rows.select(
        "doc_id", "content", F.xxhash64("component", "pair.band", "pair.x", "pair.y").alias("pair")
    )


def links(texts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links among the texts of each block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:  # sorted by pair: a block pair is a run of rows
            for row_key, s in zip(batch.column("pair").to_pylist(), shingle_sets(batch.column("text"), shingle), strict=True):
                if row_key != key:
                    yield _edges(verified(held, percent))
                    held, key = [], row_key
                held.append(s)
        yield _edges(verified(held, percent))

    wanted = pairs.select(F.col("doc_id").alias("p_id"), F.col("content").alias("p_content"), "pair").hint("merge")
    rows = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("content") == F.col("p_content")))
    rows = rows.select("pair", "text").repartition("pair").sortWithinPartitions("pair")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def verified(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the sets that connect what all their links connect."""
    names = {class_of(s): s for s in sets}
    sets = sorted(names.values(), key=len)
    if len(sets) < 2:
        return []
    n = np.array([len(s) for s in sets])
    sketches = np.array([_sketch(s) for s in sets])
    root = np.arange(len(sets))
    for i in range(len(sets) - 1):
        last = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))  # sizes that can still reach the threshold
        others = i + 1 + np.flatnonzero(root[i + 1 : last] != root[i])
        if not len(others):
            continue
        apart = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        near = others[(100 + percent) * apart <= (100 - percent) * (n[i] + n[others])]
        for j in near:
            if root[j] == root[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (n[i] + n[j] - shared):
                root[root == root[j]] = root[i]
    return _stars([class_of(s) for s in sets], root)


def _short(shingles: np.ndarray) -> np.ndarray:
    return _sketch(shingles, min(MOST_BITS, max(LEAST_BITS, 1 << max(len(shingles) - 1, 0).bit_length())))


def _sketch(shingles: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    parity = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def jaccard_join(docs: DataFrame, block: int = 512, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, content, n_shingles and component_id of each row of `docs`.

    Linked are texts whose sets of `shingle`-word shingles have a Jaccard index of `percent` % at least.
    """
    rows = labelled(docs, block, shingle, percent)
    heads = rows.where("of is not null").groupBy(F.col("of").alias("h_of")).agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    heads = checkpoint(heads)
    # A component, or the rows without one, may hold a third of all rows; only of large ones each part gets the head.
    large = heads.where(F.col("n") > LARGE).select(F.col("h_of").alias("l_of"))
    salt = F.pmod(F.xxhash64("doc_id", "content"), F.lit(SALTS)).cast("int")
    rows = rows.join(F.broadcast(large), F.col("of") == F.col("l_of"), "left")  # a thousandth of the rows at most
    rows = rows.withColumn("salt", F.when(F.col("of").isNull() | F.col("l_of").isNotNull(), salt).otherwise(0)).drop("l_of")
    parts = F.when(F.col("n") > LARGE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    # Spark sizes what comes out of the explode as what goes in: it could broadcast it, large as it is.
    heads = heads.withColumn("h_salt", F.explode(parts)).hint("merge")
    return rows.join(heads, (F.col("of") == F.col("h_of")) & (F.col("salt") == F.col("h_salt")), "left").select(
        "doc_id", "content", "n_shingles", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def labelled(docs: DataFrame, block: int, shingle: int, percent: int) -> DataFrame:
    """doc_id, content, n_shingles and `of` of each row of `docs`: the least class of its component, NULL for an empty set."""
    if not LEAST_PERCENT <= percent < 100 or shingle < 1:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 99 and shingle 1 at least, not {percent} and {shingle}")
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("content", F.xxhash64("text"))
    named = checkpoint(classes(texts, shingle))
    longest, words = (int(x or 0) for x in named.agg(F.max("n_shingles"), F.sum("n_shingles")).first())
    least = named.where("class is not null").groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("row"),
        F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"),
    )
    spark = docs.sparkSession
    met = checkpoint(meetings(texts, longest, words, shingle, percent))
    release(spark)  # the segments of all texts, of which few met
    near = checkpoint(candidates(told_apart(met), least, percent))
    release(spark)
    groups = components(near)
    grouped = least.join(groups, F.col("class") == F.col("node")).select(
        "row.doc_id", "row.content", "class", "n_shingles", "component"
    )
    linked = checkpoint(links(texts, blocked(grouped, block, longest, percent), shingle, percent))
    release(spark)  # the texts that were compared
    joined = components(linked)
    rows = named.join(joined, F.col("class") == F.col("node"), "left")
    return rows.select("doc_id", "content", "n_shingles", F.coalesce("component", "class").alias("of"))


def one_of_each(docs: DataFrame, block: int = 512, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with all columns, of which one is left of each component: that with the least id, then content.

    NULL ids come last. Of repeated rows with that id and text one is left; rows without words are all left.
    """
    found = labelled(docs, block, shingle, percent).where("of is not null")
    kept = found.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("row"))
    # `content` is never NULL; said in the type, else the other side would be cast, and sent again.
    content = F.coalesce("row.content", F.lit(0).cast("bigint")).alias("content")
    kept = kept.select(F.struct("row.doc_id", content).alias("k_key"))
    rest = [F.col(f"`{c}`") for c in docs.columns]
    # Structs compare NULL ids as equal, so that one exchange by the key serves both steps; repeats go before it.
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"))
    worded = F.coalesce(has_word(F.col("text")), F.lit(False))
    single = docs.where(worded).select(F.struct(*rest).alias("__row"), key.alias("__key")).dropDuplicates(["__key"])
    single = single.join(kept, F.col("__key") == F.col("k_key")).select("__row.*")
    return single.unionByName(docs.where(~worded).select(*rest))
