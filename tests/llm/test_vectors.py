import math
from collections import Counter

import numpy as np
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from logweir.llm import hard_negatives, vector_codes
from logweir.llm.oracles import ORACLES
from logweir.llm.vectors import kept_vectors, products

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'z' AS v", "'z' AS key", "'z' AS block", "1 AS n", "'z' AS code", "0 AS id", "'z' AS wants")


def awkward(seed=3, n=230, dim=8):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(n, dim))
    rows = [(int(i), [float(x) for x in spread[i]], int(rng.integers(0, 10))) for i in range(n)]
    hot = [0.5, -0.25] * (dim // 2)
    rows += [(1000 + i, hot, 4) for i in range(60)] + [(2000 + i, [0.25] * dim, 5) for i in range(30)]  # ties
    rows += [rows[50], rows[50], rows[100], (150, rows[150][1], rows[150][2])]  # repeats, anchors too
    rows += [(None, rows[7][1], rows[7][2]), (None, hot, 4), (250, [0.0] * dim, 1), (251, [0.0] * dim, 2)]
    rows += [(3000, None, 1), (3001, [None] * dim, 1), (3002, [math.nan] + [0.0] * (dim - 1), 1), (3003, [math.inf] + [0.0] * (dim - 1), 1),
             (3004, hot, None), (350, hot, None), (300, [30.0, -20.0] * (dim // 2), 4)]
    return rows


def sound(rows, scale):
    return [
        (i, [math.floor(scale * float(np.float32(x))) for x in v], c) for i, v, c in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]


def brute_negatives(rows):
    kept = [(i, v, (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c in sound(rows, 256) if c is not None]
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for n, (i, v, c) in enumerate(kept):
        if i is None or i % 50:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, d) for m, (j, w, d) in enumerate(kept) if m != n]
        positives = sorted((x for x in scores if x[2] == c), key=order)[:5]
        others = sorted((x for x in scores if x[2] != c), key=order)
        for s, j, _ in positives:
            found = [x for x in others if 50 * s <= 100 * x[0] <= 95 * s][:3]
            out += [(i, j, r + 1, x[1], s, x[0]) for r, x in enumerate(found)]
    return Counter(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("settings", [{}, {"block": 16, "anchor_block": 3, "n_references": 3, "sample": 20}])
def test_hard_negatives_equal_brute_force(spark, settings):
    rows = awkward()
    out = hard_negatives.hard_negatives(table(spark, rows).repartition(5), **settings)
    want = brute_negatives(rows)
    assert sum(want.values()) > 50 and Counter(tuple(r) for r in out.select(*COLUMNS).collect()) == want


def test_hard_negatives_of_little(spark):
    for rows in ([], [(50, [1.0, 2.0], 1)], [(0, [], 1), (1, [], 2)], [(50, None, 1)], [(50, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 3)]):
        out = hard_negatives.hard_negatives(table(spark, rows))
        assert Counter(tuple(r) for r in out.select(*COLUMNS).collect()) == brute_negatives(rows)


def test_large_components_are_exact_or_refused(spark):
    rows = [(50, [3e6, 1.0], 1), (1, [2e6, 3.0], 1), (2, [1.5e6, -7.0], 2), (3, [1.9e6, 7.0], 2)]
    out = hard_negatives.hard_negatives(table(spark, rows))
    assert Counter(tuple(r) for r in out.select(*COLUMNS).collect()) == brute_negatives(rows)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(table(spark, [(50, [1e30, 1.0], 1), (1, [1e30, 1.0], 1)])).collect()


def test_bounds_hold_and_skip(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12)) * 4000
    v = (centres[rng.integers(0, 6, 600)] + rng.normal(size=(600, 12)) * 40).astype(np.int64)
    refs = hard_negatives.references(v[:100], 8)
    angles, norms = hard_negatives.angles_to(v, refs)
    angles = angles.astype(np.float64)
    scores = products(v[:50], v)
    low, high = hard_negatives.pair_bounds(angles[:50], norms[:50], angles, norms)
    assert (low <= scores).all() and (scores <= high).all()
    best = np.sort(scores, axis=1)[:, -6]
    assert (high >= best[:, None]).mean() < 0.35  # of clustered vectors most pairs are out of reach
    box = hard_negatives.box_bounds(angles[:50], norms[:50], angles.min(axis=0), angles.max(axis=0), (norms.min(), norms.max()))
    assert (box[0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= box[1]).all()


def test_far_blocks_do_not_meet(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in (np.eye(4)[i % 4] * 3 + rng.normal(size=4) * 0.01)], i % 2 + 5) for i in range(400)]
    asked = []
    plain = hard_negatives.meetings

    def counted(anchors, *args):
        every = plain(anchors.withColumn("floor", F.lit(None).cast("double")), *args)
        asked.append((plain(anchors, *args), every))
        return asked[-1][0]

    hard_negatives.meetings = counted
    try:
        out = Counter(tuple(r) for r in hard_negatives.hard_negatives(table(spark, rows), block=20, anchor_block=2).select(*COLUMNS).collect())
    finally:
        hard_negatives.meetings = plain
    assert out == brute_negatives(rows)
    met, every = (df.count() for df in asked[1])  # of the negatives, where windows are known
    assert 0 < met < 0.75 * every


# --- op12


def brute_codes(rows, rounds=4, entries=256):
    kept = sound(rows, 1024)
    width = -(-max((len(v) for _, v, _ in kept), default=1) // 4) * 4
    vectors = [v + [0] * (width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    per = width // 4
    parts = [[v[p * per : (p + 1) * per] for v in vectors] for p in range(4)]
    books = [[parts[p][n] for n in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            held = {}
            for x in parts[p]:
                held.setdefault(pick(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else c for k, c in enumerate(books[p])]
    final = [[pick(parts[p][n], books[p]) for p in range(4)] for n in range(len(kept))]
    error = [sum(d for d, _ in f) for f in final]
    by_label = Counter()
    for (_, _, c), e in zip(kept, error):
        by_label[c] += e
    digest = vector_codes.codebooks_digest(np.array(books, dtype=np.int64))
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[c], digest) for (i, _, c), f, e in zip(kept, final, error))


def coded(spark, rows, **settings):
    out = vector_codes.vector_codes(table(spark, rows).repartition(4), **settings)
    return Counter(tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes_equal_brute_force(spark):
    rows = awkward()
    assert coded(spark, rows) == brute_codes(rows)
    assert coded(spark, rows, entries=9, rounds=2) == brute_codes(rows, rounds=2, entries=9)


def test_codes_of_little_and_of_uneven_vectors(spark):
    assert not coded(spark, []) and not coded(spark, [(1, None, 2)])
    for rows in ([(1, [0.5, 1.0, -2.0, 3.0], None)], [(2, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (1, [-1.0, 2.0], None), (3, [-1.0, 2.0], None)]):
        assert coded(spark, rows) == brute_codes(rows)
    with pytest.raises(Exception, match="64 bits"):
        coded(spark, [(1, [1e30] * 4, 1)])


def test_hilbert_neighbours_are_one_step_apart():
    side = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = [k.tobytes() for k in vector_codes.hilbert_keys(side, 3)]
    assert len(set(keys)) == 512
    walk = side[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_the_nearest_and_whole_blocks_go_by_their_sums():
    rng = np.random.default_rng(0)
    book = rng.integers(-1000, 1000, (256, 4))
    lengths = []
    for _ in range(200):
        points = rng.integers(-1000, 1000, 4) + rng.integers(-30, 30, (50, 4))
        few = vector_codes.shortlist(points.min(axis=0), points.max(axis=0), book)
        at, far = vector_codes.nearest(points, book)
        own, near = vector_codes.nearest(points, book[few])
        assert (few[own] == at).all() and (near == far).all()
        lengths.append(len(few))
    assert min(lengths) == 1 and np.mean(lengths) < 20
    big = points * 10**6
    at, far = vector_codes.nearest(big, book * 10**6)
    assert far.tolist() == [min(sum((int(x) - int(y)) ** 2 for x, y in zip(p, c)) for c in book * 10**6) for p in big]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes"])
def test_oracles_agree_on_awkward_rows(spark, name, tmp_path):
    rows = [r for r in awkward(n=330) if r[1] is None or len(r[1]) == 8]
    folder = tmp_path / "t"
    table(spark, rows).select("vec_id", "embedding", "label").coalesce(1).write.parquet(str(folder / "parts"))
    (file,) = (folder / "parts").glob("*.parquet")
    file.rename(folder / "embeddings.parquet")
    from logweir.llm.queries import QUERIES

    assert difference(QUERIES[name](spark, str(folder)), duck(str(folder)), ORACLES[name]) is None


def test_only_sound_vectors_are_kept(spark):
    rows = awkward()
    assert kept_vectors(table(spark, rows), 256).count() == len(sound(rows, 256))
    assert kept_vectors(table(spark, rows), 256).where(F.col("vec_id") >= 3000).count() == 1
