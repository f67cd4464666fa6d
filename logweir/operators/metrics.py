"""Latency, rate and histogram statistics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.times import from_micros, micros, seconds, time_slice

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


# Cells that a cell of values is cut into, where a wanted rank lies.
CELLS = 4096


def _value_slice(value: Column) -> Column:
    """A slice of the number line that never decreases with the value; NaN, the largest, has the last."""
    # Infinity has a slice of its own, below NaN's.
    size = F.least(F.log2(F.lit(1.0) + F.abs(value)) * F.lit(64), F.lit(2.0**60))
    return F.when(F.isnan(value), F.lit(2**62)).otherwise(F.floor(F.signum(value) * size).cast("bigint"))


def _located(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The cell of each wanted rank among rows (by, _cell, _value, _n), and the rank within it.

    Only the cells' counts are put in order: a row per cell, of which there is a fixed number.
    """
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*by, "_cell").agg(
        F.sum("_n").alias("_held"), F.min("_value").alias("_low"), F.max("_value").alias("_high")
    ).withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    here = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_held"))
    return cells.join(wanted, by).filter(here).withColumn("_rank", F.col("_rank") - F.col("_before"))


def order_statistics(
    samples: DataFrame, keys: list[str], value: str, ranks: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact sorted[int(n * p)] per key, for each named p; `weight` names a column that says how often a row counts.

    Equal values are merged before the shuffle. Then a histogram tells which slice of the
    number line holds each wanted rank, a second one which cell of that slice, and only the
    values of these cells are sorted, so no key and no dense range is sorted in one task.
    """
    if not keys:
        overall = samples.withColumn("_all", F.lit(0))
        return order_statistics(overall, ["_all"], value, ranks, weight).drop("_all")
    often = F.sum(weight) if weight else F.count("*")
    counts = samples.filter(F.col(value).isNotNull()).groupBy(
        *keys, F.col(value).cast("double").alias("_value")
    ).agg(often.alias("_n"))
    named = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(float(p)).alias("_p")) for n, p in ranks.items()])
    wanted = counts.groupBy(*keys).agg(F.sum("_n").alias("_total")).select(*keys, "_total", F.inline(named))
    wanted = wanted.select(*keys, "_name", F.floor(F.col("_total") * F.col("_p")).cast("bigint").alias("_rank"))

    sliced = counts.withColumn("_cell", _value_slice(F.col("_value")))
    slices = _located(sliced, wanted, keys).select(*keys, "_cell", "_name", "_rank", "_low", "_high")
    inside = sliced.join(slices, [*keys, "_cell"])
    share = (F.col("_value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    part = F.when(F.col("_high") > F.col("_low"), F.floor(share * F.lit(CELLS)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    inside = inside.select(*keys, "_name", "_rank", "_value", "_n", part.alias("_cell"))
    names = [*keys, "_name"]
    cells = _located(inside, inside.groupBy(*names).agg(F.first("_rank").alias("_rank")), names)
    few = inside.drop("_rank").join(cells.select(*names, "_cell", "_rank"), [*names, "_cell"])

    upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    placed = few.withColumn("_upto", upto).filter(
        (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank"))
    )
    picks = [F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in ranks]
    return placed.groupBy(*keys).agg(*picks)


def latency_stats(samples: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """Sample count, extremes, mean and percentiles per key; zeros when empty."""
    if not keys:
        # A typed group of its own, so that no samples still give one row.
        basic = _basic(samples, [], value).withColumn("_all", F.lit(0))
        overall = samples.withColumn("_all", F.lit(0))
        return _with_percentiles(basic, overall, ["_all"], value).drop("_all")
    return _with_percentiles(_basic(samples, keys, value), samples, keys, value)


def _basic(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.count(value).alias("samples"),
        F.coalesce(F.min(value), F.lit(0.0)).alias("min_ms"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_ms"),
        F.coalesce(F.max(value), F.lit(0.0)).alias("max_ms"),
    )


def _with_percentiles(
    basic: DataFrame, samples: DataFrame, keys: list[str], value: str
) -> DataFrame:
    ranks = order_statistics(samples, keys, value, {f"{n}_ms": p for n, p in PERCENTILES.items()})
    stats = basic.join(ranks, keys, "left")
    # fillna() would take NaN for a missing value too.
    return stats.withColumns({f"{n}_ms": F.coalesce(f"{n}_ms", F.lit(0.0)) for n in PERCENTILES})


def last_samples(samples: DataFrame, keys: list[str], order: list[Column], n: int = 1000) -> DataFrame:
    """The most recent `n` samples per key; each task passes on `n` at most."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    return samples.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def rate_stats(samples: DataFrame, keys: list[str], elapsed_seconds: float) -> DataFrame:
    """Sent and accepted rates and the acceptance percentage per key."""
    sums = samples.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sent", "accepted", "rejected", "failed")]
    )
    return sums.select(
        "*",
        (F.col("sent") / F.lit(float(elapsed_seconds))).alias("actual_rate"),
        (F.col("accepted") / F.lit(float(elapsed_seconds))).alias("accepted_rate"),
        F.when(F.col("sent") > 0, F.col("accepted") / F.col("sent") * 100)
        .otherwise(F.lit(0.0))
        .alias("acceptance_pct"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """Benchmark report as JSON lines."""
    report.write.mode("overwrite").json(path)


def exponential_bounds(start: float, factor: float, count: int) -> list[float]:
    return [start * factor**i for i in range(count)]


def bucket_counts(
    samples: DataFrame, keys: list[str], value: str, bounds: list[float]
) -> DataFrame:
    """Cumulative counts of values up to each bound; the last bound is infinity."""
    cells = [F.count_if(F.col(value) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    cells.append(F.count(value).alias(f"b{len(bounds)}"))
    wide = samples.groupBy(*keys).agg(*cells)
    pairs = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative"))
            for i, b in enumerate([*bounds, float("inf")])
        ]
    )
    return wide.select(*keys, F.inline(pairs))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds it.

    The first bucket starts at zero; a quantile beyond the last finite bound is
    that bound; without samples it is NaN.
    """
    along = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    rank = F.col("total") * F.lit(q)
    steps = (
        buckets.withColumn("total", F.max("cumulative").over(whole))
        .withColumn("lower", F.coalesce(F.lag("le").over(along), F.lit(0.0)))
        .withColumn("below", F.coalesce(F.lag("cumulative").over(along), F.lit(0)))
        .filter(F.col("cumulative") >= rank)
    )
    held = steps.groupBy(*keys).agg(F.min_by(F.struct("le", "lower", "below", "cumulative", "total"), "le").alias("b"))
    b = F.col("b")
    share = F.try_divide(b["total"] * F.lit(q) - b["below"], b["cumulative"] - b["below"])
    inside = b["lower"] + (b["le"] - b["lower"]) * share
    value = (
        F.when(b["total"] == 0, F.lit(float("nan")))
        .when(b["le"] == F.lit(float("inf")), b["lower"])
        .otherwise(inside)
    )
    return held.select(*keys, value.alias("quantile"))


def counter_increases(
    scrapes: DataFrame, keys: list[str], time: str, value: str, slice_seconds: int = 3600
) -> DataFrame:
    """(keys, time, increase): what a counter gained since the scrape before.

    A counter that fell was reset and counts from zero, as it does at its first scrape. Scrapes
    are compared within slices of time, and the first of a slice with the last of the slice before,
    so that no series is one task. Scrapes of one series and time count once, by the largest.
    """
    rows = scrapes.groupBy(*keys, time).agg(F.max(value).alias("_now")).withColumn("_slice", time_slice(F.col(time), slice_seconds))
    inside = Window.partitionBy(*keys, "_slice").orderBy(time)
    in_order = Window.partitionBy(*keys).orderBy("_slice")
    ends = rows.groupBy(*keys, "_slice").agg(F.max_by("_now", time).alias("_last"))
    ends = ends.select(*keys, "_slice", F.lag("_last").over(in_order).alias("_carried"))
    before = F.coalesce(F.lag("_now").over(inside), F.when(F.row_number().over(inside) == 1, F.col("_carried")))
    both = rows.join(ends, [*keys, "_slice"]).withColumn("_before", before)
    gained = F.when(F.col("_now") >= F.col("_before"), F.col("_now") - F.col("_before")).otherwise(F.col("_now"))
    return both.select(*keys, time, gained.alias("increase"))


def trailing_quantile(
    increases: DataFrame, keys: list[str], q: float, window: timedelta = timedelta(minutes=5),
    step: timedelta = timedelta(minutes=1), time: str = "timestamp", increase: str = "increase",
) -> DataFrame:
    """Quantile of the bucket rates (`le`) over the trailing window, at every step that has any scrape in it.

    The increases of a step are summed first; only these sums are spread over the windows they belong to.
    """
    width, stride = seconds(window) * 1_000_000, seconds(step) * 1_000_000
    if width % stride:
        raise ValueError("the window must be a multiple of the step")
    cell = (F.floor(micros(F.col(time)) / stride) * stride).cast("bigint")
    cells = increases.groupBy(*keys, "le", cell.alias("_cell")).agg(F.sum(increase).alias("_n"))
    ends = F.sequence(F.col("_cell") + stride, F.col("_cell") + width, F.lit(stride))
    spread = cells.select(*keys, "le", "_n", F.explode(ends).alias("_end"))
    buckets = spread.groupBy(*keys, "_end", "le").agg(F.sum("_n").alias("cumulative"))
    found = histogram_quantile(buckets, [*keys, "_end"], q)
    return found.select(*keys, from_micros(F.col("_end")).alias("window_end"), "quantile")


def event_rate(
    events: DataFrame, keys: list[str], window: timedelta = timedelta(minutes=5),
    step: timedelta = timedelta(minutes=1), time: str = "timestamp",
) -> DataFrame:
    """Events per second over the trailing window, at every step.

    Events are counted per step first; only those counts are spread over the
    windows they belong to.
    """
    width, stride = seconds(window) * 1_000_000, seconds(step) * 1_000_000
    if width % stride:
        raise ValueError("the window must be a multiple of the step")
    cell = (F.floor(micros(F.col(time)) / stride) * stride).cast("bigint")
    cells = events.groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_n"))
    # The window that ends at e covers the steps in [e - width, e).
    ends = F.sequence(F.col("_cell") + stride, F.col("_cell") + width, F.lit(stride))
    spread = cells.select(*keys, F.explode(ends).alias("_end"), "_n")
    return spread.groupBy(*keys, "_end").agg(F.sum("_n").alias("_n")).select(
        *keys,
        from_micros(F.col("_end")).alias("window_end"),
        (F.col("_n") / F.lit(float(seconds(window)))).alias("rate"),
    )
