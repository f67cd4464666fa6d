"""URL filters: rules, and link-graph propagation from trusted and blocked seeds [native].

A rule (action, host, path) fits the urls of its host and of all subdomains whose path
starts with the rule's path; the longest fitting rule decides, a block before an allow of
equal length. Urls without a rule get the verdict of their host in the link graph: a
personalised PageRank flows from trusted hosts along links, and distrust flows from
blocked hosts against them (who links to a blocked host shares in its distrust). A host
is blocked when its distrust exceeds both its trust and `threshold` over the mean seed.

Seeds: a host's share of all rule-allowed (trust) or rule-blocked (distrust) urls.
Edges: distinct pairs of different hosts, from absolute links in the pages, weighted by
their number. Every step is a join by host and a sum combined before its shuffle, so a
hub with a third of all links is summed map-side, and its out-links are split by the
adaptive join. Ranks are cut from their lineage every few steps in the shared folder.

Defined cases: a NULL url or one without "://" has an empty host and path, fits no rule
and takes the empty host's verdict (allow, as it has no links). NULL html has no links.
Repeated rows count as often as they occur and are all judged. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import LOWER, UPPER, checkpoint

URL_HOST = r"(?s)^.*?://([^/?#]*)"
URL_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL_HOST, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATH, 1)


def by_rule(rules: list[Rule], of: Column, at: Column, value) -> Column:
    """`value` of the longest rule that fits, else NULL. Rules are configuration, so they stand in the plan."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "block")):
        fits = ((of == rule.host) | of.endswith("." + rule.host)) & at.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): each host's links to other hosts as shares of its links."""
    pairs = pages.select(
        host(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"),
    ).select("src", F.translate("to", UPPER, LOWER).alias("dst"))
    pairs = pairs.where((F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))
    return pairs


def spread(seeds: DataFrame, edges: DataFrame, damping: float, steps: int, cut: int = 5) -> DataFrame:
    """(host, rank) after `steps` of rank = (1 - damping) * seed + damping * what flows in."""
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    flow = edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share"))
    ranks = seeds.select("host", F.col("seed").alias("rank"))
    for step in range(1, steps + 1):
        moved = flow.join(ranks, flow.src == ranks.host).select(
            F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank")
        )
        kept = seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))
        ranks = kept.unionByName(moved).groupBy("host").agg(F.sum("rank").alias("rank"))
        if step % cut == 0 and step < steps:
            ranks = checkpoint(ranks)
    return ranks


def url_filters(
    pages: DataFrame,
    rules: list[Rule],
    damping: float = 0.85,
    steps: int = 10,
    threshold: float = 0.1,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, trust, distrust (of the host) and verdict."""
    slim = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = slim.withColumn("rule", by_rule(rules, F.col("host"), F.col("path"), lambda r: r.name)).withColumn(
        "__ruled", by_rule(rules, F.col("host"), F.col("path"), lambda r: r.action)
    )
    hosts = ruled.groupBy("host").agg(
        F.count(F.when(F.col("__ruled") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("__ruled") == "block", 1)).alias("blocked"),
    )
    hosts = checkpoint(hosts)
    sums = hosts.agg(F.sum("allowed"), F.sum("blocked"), F.count(F.when(F.col("blocked") > 0, 1))).first()
    allowed, blocked, blocking = (int(x or 0) for x in sums)
    edges = checkpoint(host_edges(pages.select("url", "html")))
    trust = hosts.where("allowed > 0").select("host", (F.col("allowed") / F.lit(max(allowed, 1))).alias("seed"))
    distrust = hosts.where("blocked > 0").select("host", (F.col("blocked") / F.lit(max(blocked, 1))).alias("seed"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    found = reduce(
        lambda a, b: a.unionByName(b),
        (
            spread(trust, edges, damping, steps).select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")),
            spread(distrust, back, damping, steps).select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")),
        ),
    )
    found = found.groupBy(F.col("host").alias("of")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    least = threshold * (1 - damping) / max(blocking, 1)
    none = F.lit(0.0)
    trusted, distrusted = F.coalesce("trust", none), F.coalesce("distrust", none)
    verdict = F.when((distrusted > trusted) & (distrusted > least), "block").otherwise("allow")
    return ruled.join(found, F.col("host") == F.col("of"), "left").select(
        "page_id", "host", "path", "rule",
        trusted.alias("trust"), distrusted.alias("distrust"),
        F.coalesce("__ruled", verdict).alias("verdict"),
    )
