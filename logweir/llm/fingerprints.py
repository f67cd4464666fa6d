"""Document fingerprints by a threshold-scaled sketch [native].

Of the hashes of a text's distinct word shingles, those below a fixed fraction of the
hash space are retained. A sketch grows with its text, so that sketches of very unequal
texts still estimate containment, and the union of two sketches is the sketch of the
union. The smallest hash is retained in any case (also under union), so that no text
with words has an empty fingerprint. A text of fewer words than a shingle is one shingle.

Hashes are the first 16 hexadecimal digits of a shingle's md5; a fingerprint is their
sorted list, joined. Likeness is the Jaccard index of two sketches, 1 for two empty ones.

Defined cases: a NULL text is an empty one, whose fingerprint is empty. Equal texts have
equal fingerprints. Repeated rows and ties of doc_id are ordered by text. A table of one
row is its own next document. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import words

SHINGLE = 5
#: Hashes that start with a digit below this one are retained: an eighth of all.
BELOW = "2"
DIGITS = 16


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sketch of column `text`, a sorted array of hash digits, as column `name`."""
    df = df.withColumn("__words", words(F.col(text)))
    shingle = lambda i: F.md5(F.array_join(F.slice("__words", i, SHINGLE), " ").cast("binary"))
    hashes = F.when(F.size("__words") == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__words") - (SHINGLE - 1))),
            lambda i: F.substring(shingle(i), 1, DIGITS),
        )
    )
    df = df.withColumn("__hashes", hashes)
    few = F.array_distinct(F.filter("__hashes", lambda h: h < BELOW))
    df = df.withColumn("__few", few)
    least = F.when(F.size("__hashes") > 0, F.array(F.array_min("__hashes"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(name, F.when(F.size("__few") > 0, F.sort_array("__few")).otherwise(least))
    return df.drop("__words", "__hashes", "__few")


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two sketches."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def containment(a: str, b: str) -> Column:
    """Share of `a`'s shingles that `b` holds as well, however long `b` is."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: str, b: str) -> Column:
    """The sketch of both texts' shingles together."""
    both = F.array_union(a, b)
    few = F.filter(both, lambda h: h < BELOW)
    return F.when(F.size(few) > 0, F.sort_array(few)).otherwise(F.slice(F.sort_array(both), 1, 1))


def with_next(docs: DataFrame, rows_per_range: int = 8192, max_ranges: int = 20_000) -> DataFrame:
    """doc_id, text and sketch of each row, and `next`: text and sketch of the following one.

    Rows follow by descending doc_id; after the last comes the first. They are dealt into
    ranges of doc_id, so that no task holds more than its range; of the ranges' bounds and
    heads (at most `max_ranges` numbers each) the driver makes a table, and only the head
    row of each range is copied to the range before it.
    """
    spark = docs.sparkSession
    n = docs.count()
    ranges = max(1, min(max_ranges, n // rows_per_range))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = docs.select(F.percentile_approx("doc_id", steps, 10 * max_ranges)).first()[0] if steps else []
    bounds = F.lit(sorted(set(bounds or []))).cast("array<bigint>")
    # NULL ids come last in descending order: a range below all others.
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    docs = docs.withColumn("range", at)
    first = {r["range"]: r["id"] for r in docs.groupBy("range").agg(F.max("doc_id").alias("id")).collect()}
    used = sorted(first, reverse=True)
    follows = [(r, after, first[after]) for r, after in zip(used, used[1:] + used[:1], strict=True)]
    follows = spark.createDataFrame(follows, "before int, h_range int, h_id bigint")
    heads = docs.join(F.broadcast(follows), (F.col("range") == F.col("h_range")) & F.col("doc_id").eqNullSafe(F.col("h_id")))
    heads = heads.groupBy("before").agg(F.max("text").alias("text"))
    # A copy of each head row stands last in the range before it; texts cross once, sketches not at all.
    rows = docs.select("range", F.lit(0).alias("copied"), "doc_id", "text").unionByName(
        heads.select(F.col("before").alias("range"), F.lit(1).alias("copied"), F.lit(None).cast("bigint").alias("doc_id"), "text")
    )
    rows = with_sketch(rows.repartition("range"), "text", "sketch")
    w = Window.partitionBy("range").orderBy("copied", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    rows = rows.withColumn("next", F.lead(F.struct("text", "sketch")).over(w))
    return rows.where("copied = 0").select("doc_id", "text", "sketch", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text and sketch of each row, for mergeable containment estimates."""
    return with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(slim).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    head = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    df = df.withColumn("edited", F.concat(head, F.substring(F.col("next.text"), F.lit(1), half)))
    df = df.withColumn("next_sketch", F.col("next.sketch")).drop("next", "text")
    df = with_sketch(df, "edited", "edited_sketch")
    return df.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
