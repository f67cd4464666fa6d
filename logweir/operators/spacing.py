"""Keep a time only if the last kept one of its key is far enough back.

This is a greedy chain: whether a time is kept depends on all before it. But what a
block of time makes of the last kept time is a step function, and its steps are few,
because chains that start apart soon run together. So each block of a
key is turned into its steps in a task of its own; a walk over the steps, a short row
per block, gives the time kept before every block; and then all blocks are gone
through at once. Times are merged to distinct milliseconds first, which bounds a
block by its length, whatever its number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.chain import block_steps, spaced_positions, step
from logweir.functions.times import micros, seconds
from logweir.session import stored

# Minutes of a block: 1.8 million milliseconds at most.
BLOCK_MINUTES = 30
_MINUTE = 60_000


def millis(ts: Column) -> Column:
    return F.floor(micros(ts) / F.lit(1000)).cast("bigint")


def from_millis(value: Column) -> Column:
    return F.timestamp_millis(value).cast("timestamp_ntz")


def spaced(
    rows: DataFrame,
    keys: list[str],
    gap: timedelta,
    strict: bool = False,
    block_minutes: int = BLOCK_MINUTES,
) -> DataFrame:
    """The kept (keys, at) of rows with a BIGINT millisecond column `at`."""
    minute = F.floor(F.col("at") / _MINUTE).cast("bigint")
    offset = (F.col("at") - minute * _MINUTE).cast("int")
    # A minute's instants are one short array, so that the keys, which may be
    # long texts, do not travel with every instant.
    minutes = rows.groupBy(*keys, minute.alias("minute")).agg(F.collect_set(offset).alias("offsets"))
    blocks = stored(minutes.withColumn("block", F.floor(F.col("minute") / block_minutes).cast("bigint")))
    gap_ms, span_ms = seconds(gap) * 1000, block_minutes * _MINUTE
    return _kept(blocks, _entries(_steps(blocks, keys, gap_ms, span_ms, strict), keys, gap_ms, strict), keys, gap_ms, strict)


def _times(group: pd.DataFrame) -> np.ndarray:
    parts = [m * _MINUTE + np.asarray(o, "int64") for m, o in zip(group["minute"], group["offsets"])]
    return np.sort(np.concatenate(parts))


def _steps(blocks: DataFrame, keys: list[str], gap: int, span: int, strict: bool) -> DataFrame:
    """(keys, block, starts, lasts): the step function of every block."""

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["block"].iloc[0])
        starts, lasts = block_steps(_times(group), block * span, gap, strict)
        first = group[[*keys, "block"]].head(1)
        return first.assign(starts=[starts.astype("int64").tobytes()], lasts=[lasts.astype("int64").tobytes()])

    schema = blocks.select(*keys, "block").schema.add("starts", "binary").add("lasts", "binary")
    return blocks.groupBy(*keys, "block").applyInPandas(steps, schema)


def _entries(steps: DataFrame, keys: list[str], gap: int, strict: bool) -> DataFrame:
    """(keys, block, last): the time kept before every block, NULL before a key's first."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:  # a key's blocks follow one another, in order
            before = []
            values = [batch.column(c).to_pylist() for c in (*keys, "starts", "lasts")]
            for *own, starts, lasts in zip(*values):
                if own != key:
                    key, last = own, None
                before.append(last)
                last = step(np.frombuffer(starts, "int64"), np.frombuffer(lasts, "int64"), gap, strict, last)
            names = [*keys, "block"]
            columns = [*(batch.column(c) for c in names), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "last"])

    schema = steps.select(*keys, "block", F.col("block").alias("last")).schema
    for field in schema.fields:
        field.nullable = True
    return steps.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(walk, schema)


def _kept(blocks: DataFrame, entries: DataFrame, keys: list[str], gap: int, strict: bool) -> DataFrame:
    def keep(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        times = _times(group)
        last = before["last"].iloc[0]
        kept = times[spaced_positions(times, gap, strict, None if pd.isna(last) else int(last))]
        return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, "at": kept}, columns=[*keys, "at"])

    schema = blocks.select(*keys, F.col("minute").alias("at")).schema
    by = [*keys, "block"]
    return blocks.groupBy(*by).cogroup(entries.groupBy(*by)).applyInPandas(keep, schema)
