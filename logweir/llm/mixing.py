"""Mixing sources to target weights.

The words of each source, its documents in a fixed order, are packed into blocks of
`block` words. The mix is a row of output shards of so many slots; how many of a shard's
slots go to which source is a multinomial draw by target. The k-th slot of a source
takes block p(k mod blocks) of its k div blocks-th pass over the source, p being a
pseudorandom permutation of the source's block indices (a keyed Feistel network, another
one in each pass), and slots and documents meet in a join by source and block index.

Draws alone would leave each source a square root off its target. Their sums are settled:
the slots that a source has beyond its quota go, in order, to the sources that are short
of theirs. Quotas are whole blocks, so a source comes within half a block of its target.
No pass takes a block twice and no quota exceeds three passes, hence no document is taken
more than three times.

Word positions are sums over buckets of a few thousand documents, then sums within each
bucket, so a source with a third of all rows is not one task. Sources (at most
`max_sources`; more are an error) are the only thing the driver holds.

Defined cases: a NULL or wordless text has size 0 and is never taken. NULL is a source
like others, ordered last. Repeated rows are documents of their own. An empty table gives
an empty result. A source of size 0 has target 0. Extra columns pass through `mix` only if
asked for. Reruns give the same mix: all draws are keyed by seed, shard, source and pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import n_words

WEIGHTS = (5, 2, 1)
REPEATS = 3


class Source(NamedTuple):
    s: int
    source: str | None
    size: int
    documents: int
    target: float
    blocks: int
    quota: int


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Shares of all sizes by weight; a source stops at `repeats` times its size, the rest is reshared."""
    total, own = sum(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        open_weight = sum(w for i, w in enumerate(own) if i not in full)
        rest = total - sum(repeats * sizes[i] for i in full)
        above = [i for i, w in enumerate(own) if i not in full and rest * w / open_weight > repeats * sizes[i]]
        if not above:
            break
        full.update(above)
    return [float(repeats * n) if i in full else rest * own[i] / open_weight for i, n in enumerate(sizes)]


def plan_sources(docs: DataFrame, block: int, max_sources: int) -> list[Source]:
    """Size, target, blocks and quota of each source, in code point order, NULL last."""
    rows = (
        docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("size"), F.count(F.lit(1)).alias("documents"))
        .orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    )
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold them")
    wanted = targets([r["size"] for r in rows])
    out = []
    for s, (row, target) in enumerate(zip(rows, wanted, strict=True)):
        blocks = -(-row["size"] // block)
        quota = round(target * blocks / row["size"]) if row["size"] else 0
        out.append(Source(s, row["source"], row["size"], row["documents"], target, blocks, min(quota, REPEATS * blocks)))
    return out


def placed(docs: DataFrame, sources: list[Source], columns: list[str], per_bucket: int = 4096) -> DataFrame:
    """Each document with its source's number `s`, its size and the place `at` of its first word in the source."""
    known = docs.sparkSession.createDataFrame(
        [(x.s, x.source, max(1, -(-x.documents // per_bucket))) for x in sources], "s int, of string, buckets int"
    )
    carried = list(dict.fromkeys([*columns, "doc_id", "source"]))
    rows = docs.select(*carried, n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")).cast("int")
    )
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("s").alias("b_s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("s", "bucket").orderBy("doc_id", "size", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(starts, (F.col("s") == F.col("b_s")) & (F.col("bucket") == F.col("b"))).select(
        *columns, "s", "size", (F.col("start") + F.col("inside")).alias("at")
    )


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Where each index goes under the keyed permutation of range(n), element by element."""
    bits = np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, limit, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():  # a value outside the range walks on until it is back inside
        low, high, m, h, k = x[todo] & mask[todo], x[todo] >> half[todo], mask[todo], half[todo], key[todo]
        for r in range(rounds):
            low, high = high ^ (_mixed(low + k + np.uint64(r)) & m), low
        x[todo] = (high << h) | low
        todo[todo] = x[todo] >= limit[todo]
    return x.astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(spark, sources: list[Source], seed: int, per_shard: int) -> DataFrame:
    """(shard, s, pass_no, block) of every slot of the mix."""
    quota = np.array([x.quota for x in sources], dtype=np.int64)
    blocks = np.array([x.blocks for x in sources], dtype=np.int64)
    total = int(quota.sum())
    empty = spark.createDataFrame([], "shard bigint, s int, pass_no int, block bigint")
    if not total:
        return empty
    odds, shards = quota / total, -(-total // per_shard)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = min(per_shard, total - shard * per_shard)
                drawn = np.random.default_rng([seed, int(shard)]).multinomial(n, odds)
                own = np.flatnonzero(drawn)
                yield pd.DataFrame({"shard": int(shard), "s": own.astype(np.int32), "drawn": drawn[own]})

    drawn = spark.range(shards).mapInPandas(draw, "shard bigint, s int, drawn bigint")
    sums = np.zeros(len(sources), np.int64)
    for row in drawn.groupBy("s").agg(F.sum("drawn").alias("n")).collect():
        sums[row["s"]] = row["n"]
    over = np.maximum(sums - quota, 0)
    short = np.maximum(quota - sums, 0)
    over_from, short_to = np.cumsum(over) - over, np.cumsum(short)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shard, s = np.repeat(batch["shard"], batch["drawn"]), np.repeat(batch["s"].to_numpy(), batch["drawn"])
            k = np.concatenate([np.arange(a, a + n) for a, n in zip(batch["start"], batch["drawn"], strict=True)])
            j = np.flatnonzero(k >= quota[s])
            if len(j):
                surplus = over_from[s[j]] + k[j] - quota[s[j]]
                to = np.searchsorted(short_to, surplus, side="right")
                k[j], s[j] = sums[to] + surplus - (short_to[to] - short[to]), to
            pass_no = k // blocks[s]
            key = _mixed(np.uint64(seed) + _mixed(s.astype(np.uint64) * np.uint64(REPEATS + 1) + pass_no.astype(np.uint64)))
            yield pd.DataFrame(
                {"shard": shard.to_numpy(), "s": s, "pass_no": pass_no.astype(np.int32), "block": permuted(k % blocks[s], blocks[s], key)}
            )

    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    started = drawn.withColumn("start", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    return started.mapInPandas(place, empty.schema)


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document reaches into: `first` word in the document and `words` there."""
    at, size = F.col("at"), F.col("size")
    out = rows.where(size > 0).withColumn("block", F.explode(F.sequence(F.floor(at / block), F.floor((at + size - 1) / block))))
    first = F.greatest(F.col("block") * block, at) - at
    last = F.least((F.col("block") + 1) * block, at + size) - at
    return out.withColumn("first", first).withColumn("words", last - first)


def mix_sizes(docs: DataFrame, block: int = 128, per_shard: int = 4096, seed: int = 17, max_sources: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    slim = docs.select("doc_id", "source", "text")
    sources = plan_sources(slim, block, max_sources)
    spark = docs.sparkSession
    rows = placed(slim, sources, ["doc_id", "source"])
    chosen = slots(spark, sources, seed, per_shard).select(F.col("s").alias("c_s"), F.col("block").alias("c_block"))
    parts = pieces(rows, block)
    # Spark can't know that the slots are as many as the blocks: it would send them all to every task.
    taken = parts.join(chosen.hint("merge"), (F.col("s") == F.col("c_s")) & (F.col("block") == F.col("c_block")), "left")
    # `at` tells the rows of a source apart, also repeated ones: documents with words never share it.
    taken = taken.groupBy("doc_id", "s", "size", "at").agg(
        F.sum(F.when(F.col("c_s").isNotNull(), F.col("words")).otherwise(0)).alias("taken")
    )
    none = rows.where(F.col("size") == 0).select("doc_id", "s", "size", "at", F.lit(0).cast("bigint").alias("taken"))
    known = spark.createDataFrame([(x.s, x.size, x.target) for x in sources], "k_s int, source_size bigint, target double")
    return taken.unionByName(none).join(F.broadcast(known), F.col("s") == F.col("k_s")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


#: A word with the white space behind it, the first also with that before it.
PARTS = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def mix(docs: DataFrame, block: int = 128, per_shard: int = 4096, seed: int = 17, max_sources: int = 100_000) -> DataFrame:
    """The mix itself: shard, pass_no, block; s, at, first and the text of each document in the block; its other columns as row."""
    sources = plan_sources(docs.select("source", "text"), block, max_sources)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = placed(docs.select("doc_id", "source", "text", others), sources, ["row", "text"])
    rows = rows.where("size > 0").select("row", "s", "at", F.regexp_extract_all("text", F.lit(PARTS), F.lit(0)).alias("own"))
    # A text is cut once; that its words are counted here keeps the cut out of the function below.
    at, end = F.col("at"), F.col("at") + F.size("own")

    def piece(index: Column) -> Column:
        first, last = F.greatest(index * block, at) - at, F.least((index + 1) * block, end) - at
        text = F.array_join(F.slice("own", (first + 1).cast("int"), (last - first).cast("int")), "")
        return F.struct(index.alias("block"), first.alias("first"), (last - first).alias("words"), text.alias("text"))

    reached = F.sequence(F.floor(at / block), F.floor((end - 1) / block))
    parts = rows.select("row", "s", "at", F.inline(F.transform(reached, piece)))
    chosen = slots(docs.sparkSession, sources, seed, per_shard).select("shard", "pass_no", F.col("s").alias("c_s"), F.col("block").alias("c_block"))
    return parts.join(chosen.hint("merge"), (F.col("s") == F.col("c_s")) & (F.col("block") == F.col("c_block"))).drop("c_s", "c_block")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: for each document and pass what is taken of it, in order, with its columns."""
    rows = mix(docs, **settings).groupBy("row", "s", "at", "pass_no").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("first", F.col("text").alias("part"))))["part"], "").alias("text")
    )
    values = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in values:
        values["n_chars"] = F.length("text").cast("long")
    return rows.select(*[values[c].alias(c) for c in docs.columns])
