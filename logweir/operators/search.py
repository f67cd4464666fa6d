"""Search over the hot table, the archive or both, newest first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.times import ntz, time_slice
from logweir.params import Retention, SearchRequest
from logweir.schema import LOG_COLUMNS

# A page that ends beyond this many rows is located by counts first, because
# offset + limit rows would otherwise travel to one task.
DEEP_PAGE = 100_000


def contains_folded(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def in_range(start: datetime, end: datetime, open_end: bool = False) -> Column:
    timestamp = F.col("timestamp")
    upper = timestamp < ntz(end) if open_end else timestamp <= ntz(end)
    return (timestamp >= ntz(start)) & upper


def _to_ms(value: datetime) -> datetime:
    return value.replace(microsecond=value.microsecond // 1000 * 1000)


def filter_hot(logs: DataFrame, req: SearchRequest) -> DataFrame:
    """Exact severity; bounds at millisecond precision, both inclusive."""
    rows = logs.filter(in_range(_to_ms(req.start), _to_ms(req.end)))
    if req.service:
        rows = rows.filter(F.col("service") == req.service)
    if req.severity:
        rows = rows.filter(F.col("severity") == req.severity)
    if req.search:
        rows = rows.filter(contains_folded(F.col("message"), req.search))
    return rows


def filter_cold(logs: DataFrame, req: SearchRequest, open_end: bool = False) -> DataFrame:
    """Severity of the raw event, whatever its case; exact time bounds."""
    rows = logs.filter(in_range(req.start, req.end, open_end))
    if req.service:
        rows = rows.filter(F.col("service") == req.service)
    if req.severity:
        fold = lambda text: F.lower(F.upper(text))  # noqa: E731  also folds U+017F, as decoding does
        rows = rows.filter(fold(F.col("severity")) == fold(F.lit(req.severity)))
    if req.search:
        rows = rows.filter(contains_folded(F.col("message"), req.search))
    return rows


def attribute_at_least(name: str, minimum: int) -> Column:
    """Predicate on a numeric attribute of the hot table's JSON text."""
    value = F.try_variant_get(F.try_parse_json("attributes"), f"$['{name}']", "bigint")
    return value >= minimum


def attribute_equals(name: str, text: str) -> Column:
    """Predicate on an attribute's text: a number or boolean compares as it prints."""
    value = F.try_variant_get(F.try_parse_json("attributes"), f"$['{name}']", "string")
    return value == text


def attribute_contains(name: str, text: str) -> Column:
    """Predicate on a part of an attribute's text, whatever its case."""
    value = F.try_variant_get(F.try_parse_json("attributes"), f"$['{name}']", "string")
    return contains_folded(value, text)


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("event_id")]


def page_of(rows: DataFrame, req: SearchRequest, deep_page: int = DEEP_PAGE) -> DataFrame:
    """One page, newest first; equal times are ordered by event id."""
    if req.offset < 0:
        raise ValueError("offset must not be negative")
    offset = req.offset
    if req.offset + req.limit > deep_page:
        rows, offset = _seek(rows, req)
    page = rows.orderBy(*newest_first())
    if offset:
        page = page.offset(offset)
    return page.limit(req.limit)


def _seek(rows: DataFrame, req: SearchRequest, slice_seconds: int = 60) -> tuple[DataFrame, int]:
    """Rows of the minutes a deep page falls into, and the offset left in them."""
    minute = time_slice(F.col("timestamp"), slice_seconds)
    counts = rows.groupBy(minute.alias("slice")).agg(F.count("*").alias("n"))
    newer = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    hit = placed.filter(
        (F.col("before") < req.offset + req.limit) & (F.col("before") + F.col("n") > req.offset)
    ).agg(F.min("slice"), F.max("slice"), F.min("before")).first()
    oldest, newest, before = hit
    if oldest is None:
        return rows.limit(0), 0
    return rows.filter(minute.between(oldest, newest)), req.offset - before


def total_of(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def route(req: SearchRequest, as_of: datetime, retention: Retention = Retention()) -> str:
    """Which tiers hold the requested range: hot, cold or merged."""
    cutoff = retention.cutoff(as_of)
    if req.end < cutoff:
        return "cold"
    return "hot" if req.start > cutoff else "merged"


@dataclass(frozen=True)
class SearchResult:
    page: DataFrame
    total: DataFrame
    source: str
    degraded: tuple[str, ...] = ()


def search(
    hot: Callable[[SearchRequest], DataFrame],
    cold: Callable[[SearchRequest], DataFrame],
    request: SearchRequest,
    as_of: datetime,
    retention: Retention = Retention(),
    deep_page: int = DEEP_PAGE,
) -> SearchResult:
    """Route a search and return its page, exact total and source.

    `hot` and `cold` open a tier for a resolved request, so that they can prune
    partitions by its range. In a merged search each tier answers its side of
    the cutoff, which itself belongs to the hot side only. A tier that cannot be
    opened is left out and named in `degraded`; if none can, the error is raised.
    """
    req = request.resolved(as_of)
    source = route(req, as_of, retention)
    cutoff = retention.cutoff(as_of)
    branches, degraded, failure = [], [], None

    if source in ("hot", "merged"):
        side = req if source == "hot" else replace(req, start=cutoff)
        try:
            branches.append(filter_hot(hot(side), side).select(*LOG_COLUMNS))
        except AnalysisException as error:
            degraded.append("hot")
            failure = error
    if source in ("cold", "merged"):
        side = req if source == "cold" else replace(req, end=cutoff)
        try:
            branches.append(
                filter_cold(cold(side), side, open_end=source == "merged").select(*LOG_COLUMNS)
            )
        except AnalysisException as error:
            degraded.append("cold")
            failure = error
    if not branches:
        raise failure

    rows = branches[0]
    if len(branches) == 2:
        rows = rows.unionByName(branches[1])
    total = total_of(rows)
    reach = req.offset + req.limit
    if len(branches) == 2 and reach <= deep_page:
        # A page never needs more than its own reach from either tier.
        top = [b.orderBy(*newest_first()).limit(reach) for b in branches]
        rows = top[0].unionByName(top[1])
    return SearchResult(page_of(rows, req, deep_page), total, source, tuple(degraded))


class ScanBudgetExceeded(RuntimeError):
    pass


def within_scan_budget(rows: DataFrame, max_rows: int) -> DataFrame:
    """The rows unchanged, or an error when a scan would read too many."""
    # Counted where the rows are; a limit would gather as many rows in one task.
    if rows.count() > max_rows:
        raise ScanBudgetExceeded(f"more than {max_rows} archived rows to read: choose a shorter range")
    return rows
