"""Per-key state machines of the detection and alert streams.

Rows reach a state machine in the order of their times, whatever the order in which they
came: they wait in the key's state, filed by cells of time, until the watermark says
that no earlier one can come. A cell's rows are then sorted and worked through with
array operations. Rows behind the watermark are late for good; Spark drops and counts them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor

from logweir.functions.chain import spaced_positions


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow value: state takes it as it is, not member by member."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_pandas()


class InOrder(StatefulProcessor):
    """Files rows by cells of time and hands on each cell once the watermark has passed it.

    Subclasses name the columns they need beside `at`, work through a cell's rows in
    `advance` and tell in `idle` when a key can be forgotten.
    """

    columns: dict[str, str] = {}

    def __init__(self, delay_ms: int):
        # Short against the delay, so that a cell adds little to it.
        self.cell_ms = max(1000, delay_ms // 8)

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "cell BIGINT, piece BIGINT", "rows BINARY")
        self.pieces = handle.getValueState("pieces", "n BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        batch = self.merged(pd.concat(list(rows), ignore_index=True)[["at", *self.columns]])
        piece = self.pieces.get()[0] + 1 if self.pieces.exists() else 0
        for cell, part in batch.groupby(batch["at"] // self.cell_ms, sort=False):
            self.waiting.updateValue((int(cell), piece), (packed(part),))
            self.handle.registerTimer((int(cell) + 1) * self.cell_ms)
        self.pieces.update((piece,))
        return iter([])

    def merged(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        filed = sorted(tuple(k) for k in self.waiting.keys())
        due = [k for k in filed if (k[0] + 1) * self.cell_ms <= passed]
        for cell in dict.fromkeys(k[0] for k in due):
            pieces = [k for k in due if k[0] == cell]
            parts = [unpacked(self.waiting.getValue(k)[0]) for k in pieces]
            yield from self.advance(key, pd.concat(parts, ignore_index=True))
            for k in pieces:
                self.waiting.removeKey(k)
        if len(due) == len(filed):
            until = self.idle()
            if until is not None and until < passed:
                self.state.clear()
                self.pieces.clear()
            elif until is not None:
                self.handle.registerTimer(until + 1)

    def advance(self, key, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def idle(self) -> int | None:
        """The time after which nothing that is to come depends on the state."""
        raise NotImplementedError

    def close(self):
        pass


class AnchoredWindows(InOrder):
    """Error rate of windows that start at a service's first event.

    Emits a row for each event after which the window breaks the threshold, and
    one snapshot of each window that a cell touched (`event_id` is empty).
    """

    columns = {"event_id": "STRING", "is_error": "BOOLEAN"}

    def __init__(self, delay_ms: int, window_ms: int, min_events: int, threshold: float):
        super().__init__(delay_ms)
        self.window_ms = window_ms
        self.min_events = min_events
        self.threshold = threshold

    def init(self, handle):
        super().init(handle)
        self.state = handle.getValueState("window", "start BIGINT, total BIGINT, errors BIGINT")

    def advance(self, key, batch):
        batch = batch.sort_values(["at", "event_id"], ignore_index=True)
        times = batch["at"].to_numpy()
        errors = batch["is_error"].to_numpy().astype("int64")
        start, total, bad = self.state.get() if self.state.exists() else (None, 0, 0)
        position = 0
        while position < len(times):
            if start is None or times[position] - start > self.window_ms:
                start, total, bad = int(times[position]), 0, 0
            until = int(np.searchsorted(times, start + self.window_ms, "right"))
            part = slice(position, max(until, position + 1))
            seen = total + np.arange(1, part.stop - part.start + 1)
            wrong = bad + np.cumsum(errors[part])
            total, bad = int(seen[-1]), int(wrong[-1])
            hit = (seen >= self.min_events) & (wrong / seen >= self.threshold)
            columns = {"start": start, "at": times[part], "event_id": batch["event_id"][part]}
            fired = pd.DataFrame(columns).assign(total=seen, errors=wrong)[hit]
            snapshot = pd.DataFrame(
                {"start": [start], "at": [times[part][-1]], "event_id": [""], "total": [total], "errors": [bad]}
            )
            out = pd.concat([fired, snapshot], ignore_index=True)
            out.insert(0, "service", key[0])
            yield out
            position = part.stop
        self.state.update((start, total, bad))

    def idle(self):
        return self.state.get()[0] + self.window_ms if self.state.exists() else None


def merge_instants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side sum: an error storm shrinks to one row per pattern and instant."""
    for rows in batches:
        keys = ["service", "template", "timestamp", "at"]
        yield rows.groupby(keys, as_index=False, sort=False)["n"].sum()


class RecurringErrors(InOrder):
    """Count of an error pattern since it was first seen, and its alerts."""

    columns = {"n": "BIGINT"}

    def __init__(self, delay_ms: int, limit: int, idle_ms: int, cooldown_ms: int):
        super().__init__(delay_ms)
        self.limit = limit
        self.idle_ms = idle_ms
        self.cooldown_ms = cooldown_ms

    def init(self, handle):
        super().init(handle)
        self.state = handle.getValueState(
            "pattern", "count BIGINT, first BIGINT, last BIGINT, alerted BIGINT"
        )

    def merged(self, batch):
        return batch.groupby("at", as_index=False)["n"].sum()

    def advance(self, key, batch):
        batch = self.merged(batch)
        times, copies = batch["at"].to_numpy(), batch["n"].to_numpy()
        count, first, last, alerted = self.state.get() if self.state.exists() else (0, None, None, None)
        # Stretches without an idle gap; the first one may go on from the state.
        breaks = np.flatnonzero(np.diff(times) > self.idle_ms) + 1
        for part in np.split(np.arange(len(times)), breaks):
            at, n = times[part], copies[part]
            if last is not None and at[0] - last > self.idle_ms:
                count, first, alerted = 0, None, None
            first = int(at[0]) if first is None else first
            prior = count + np.cumsum(n) - n
            over = np.flatnonzero(prior + n > self.limit)
            kept = over[spaced_positions(at[over], self.cooldown_ms, True, alerted)]
            if len(kept):
                alerted = int(at[kept[-1]])
                yield pd.DataFrame(
                    {
                        "service": key[0],
                        "template": key[1],
                        "at": at[kept],
                        "count": np.maximum(prior[kept], self.limit) + 1,
                        "first_seen": first,
                    }
                )
            count += int(n.sum())
            last = int(at[-1])
        self.state.update((count, first, last, alerted))

    def idle(self):
        return self.state.get()[2] + self.idle_ms if self.state.exists() else None


class Cooldown(InOrder):
    """Lets an alert through when its fingerprint has been quiet long enough."""

    def __init__(self, delay_ms: int, quiet_ms: int, columns: dict[str, str]):
        super().__init__(delay_ms)
        self.quiet_ms = quiet_ms
        self.columns = columns

    def init(self, handle):
        super().init(handle)
        self.state = handle.getValueState("delivered", "last BIGINT")

    def merged(self, batch):
        # Of the alerts of one instant only the first can be let through.
        return batch.sort_values(["at", "id"]).drop_duplicates("at")

    def advance(self, key, batch):
        batch = self.merged(batch).reset_index(drop=True)
        last = self.state.get()[0] if self.state.exists() else None
        kept = spaced_positions(batch["at"].to_numpy(), self.quiet_ms, False, last)
        if kept:
            self.state.update((int(batch["at"].iloc[kept[-1]]),))
            yield batch.iloc[kept]

    def idle(self):
        return self.state.get()[0] + self.quiet_ms if self.state.exists() else None


cloudpickle.register_pickle_by_value(sys.modules[__name__])
