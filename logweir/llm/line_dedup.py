"""Line dedup by site-relative frequency [native].

The pages of a host (here: documents of a source) that hold a line are divided by the
host's pages; a line above `ratio` is boilerplate there from all of the host's pages. One or two pages (fewer than `min_pages`) are chance. The boilerplate lines of a host number at
most its lines per page over `ratio`, whatever its size.

Pages are told apart by their text: copies of one page count once on both sides, else a
copied page would lose all of its lines.

Defined cases: a NULL text stays NULL. NULL hosts form one host. Lines without a word
are never dropped. A page all of whose lines go keeps an empty text. Repeated rows are
all kept and changed alike. An empty table gives an empty result. Extra columns pass
through, whatever their names; only `text` (and `n_chars`, where there is one) changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import has_word, line_key, lines


def boilerplate_lines(docs: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, content, dropped): hashes of the lines to drop, for each distinct page that has any."""
    pages = docs.select(F.col("source").alias("host"), F.xxhash64("text").alias("content"), F.explode(lines(F.col("text"))).alias("l"))
    rows = pages.where(has_word(F.col("l"))).select("host", "content", F.xxhash64(line_key(F.col("l"))).alias("line")).distinct()
    totals = docs.groupBy(F.col("source").alias("of")).agg(F.countDistinct(F.xxhash64("text")).alias("pages"))
    drop = (
        rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("holding")).where(F.col("holding") >= min_pages)
        .join(totals, F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("holding") > ratio * F.col("pages"))
        .select(F.col("host").alias("r_host"), F.col("line").alias("r_line"))
    )
    marked = rows.join(drop, F.col("host").eqNullSafe(F.col("r_host")) & (F.col("line") == F.col("r_line")), "left_semi")
    return marked.groupBy("host", "content").agg(F.collect_set("line").alias("dropped"))


def line_dedup(docs: DataFrame, ratio: float = 0.02, min_pages: int = 3, counted: str | None = None) -> DataFrame:
    """`docs` without the boilerplate lines of each host; `counted` names a column for their number."""
    marks = boilerplate_lines(docs.select("source", "text"), ratio, min_pages)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col("source").alias("__host"), F.xxhash64("text").alias("__content"),
    )
    out = packed.join(
        marks, F.col("__host").eqNullSafe(F.col("host")) & (F.col("__content") == F.col("content")), "left"
    ).withColumn("__all", F.when(F.col("dropped").isNotNull(), lines(F.col("__row.text"))))
    left = F.filter("__all", lambda l: ~(has_word(l) & F.array_contains("dropped", F.xxhash64(line_key(l)))))
    out = out.withColumn("__left", left)
    text = F.when(F.col("__left").isNull(), F.col("__row.text")).otherwise(F.array_join("__left", "\n"))
    values = []
    for name in docs.columns:
        value = F.col(f"__row.`{name}`")
        if name == "text":
            value = text
        elif name == "n_chars":
            value = F.when(F.col("__left").isNull(), value).otherwise(F.length(text).cast("long"))
        values.append(value.alias(name))
    if counted:
        values.append((F.coalesce(F.size("__all") - F.size("__left"), F.lit(0))).cast("long").alias(counted))
    return out.select(*values)
