"""Write batching: rows are held per lane until there are enough of them, or the first has waited.

A lane is one writer. Its rows go out as soon as ``size`` of them are there, and otherwise when the
oldest has waited ``wait_ms``, by a timer, also if no further row comes. By the clock for a live
writer; by event time under a watermark for replays, where the same rows give the same batches.
Several lanes work side by side, so no source or writer gathers the whole stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SIZE, WAIT_MS = 500, 100
LANES = 8


def cuts(ms: np.ndarray, size: int, wait_ms: int, now: int) -> list[tuple[int, int]]:
    """Limits of the batches that are closed, among rows sorted by time; the rest stays held.

    A batch closes when it is full, when a row comes ``wait_ms`` or more after its first, or when
    ``now`` is that late.
    """
    out, a = [], 0
    while a < len(ms):
        b = min(a + size, int(np.searchsorted(ms, ms[a] + wait_ms, "left")))
        if b == len(ms) and b - a < size and now < ms[a] + wait_ms:
            break
        out.append((a, b))
        a = b
    return out


class WriteBatches(StatefulProcessor):
    """The held rows of a lane and the number of its next batch."""

    def __init__(self, size: int, wait_ms: int, by_clock: bool):
        self.size, self.wait_ms, self.by_clock = size, wait_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ms bigint, event_id string, value string")
        self.next = handle.getValueState("next", "batch bigint")

    def _now(self, timer_values) -> int:
        t = timer_values
        return t.getCurrentProcessingTimeInMs() if self.by_clock else t.getCurrentWatermarkInMs()

    def _release(self, key, rows: pd.DataFrame, now: int) -> pd.DataFrame:
        """The closed batches of the lane; what is left is held, with a timer on its first row."""
        number = self.next.get()[0] if self.next.exists() else 0
        closed = cuts(rows["ms"].to_numpy("int64"), self.size, self.wait_ms, now)
        # The batches follow one another from the first row on, so all go out as one frame.
        sizes = np.array([b - a for a, b in closed], dtype="int64")
        out = rows.iloc[: sizes.sum()].assign(
            lane=key[0], batch=np.repeat(number + np.arange(len(sizes)), sizes), size=np.repeat(sizes, sizes)
        )
        left = rows.iloc[closed[-1][1] if closed else 0 :]
        self.next.update((number + len(closed),))
        if len(left):
            self.held.put([(int(r.ms), r.event_id, r.value) for r in left.itertuples()])
        else:
            self.held.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(left):
            self.handle.registerTimer(int(left["ms"].iloc[0]) + self.wait_ms)
        return out[["lane", "batch", "size", "event_id", "value"]]

    def _rows(self) -> pd.DataFrame:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        return pd.DataFrame(held, columns=["ms", "event_id", "value"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        new = pd.concat(list(rows))[["ms", "event_id", "value"]].sort_values(["ms", "event_id"])
        if self.by_clock:
            new = new.assign(ms=now)
        held = self._rows()
        rows = pd.concat([held, new]) if len(held) else new
        if not self.by_clock:  # a late row takes its place among the held ones
            rows = rows.sort_values(["ms", "event_id"])
        out = self._release(key, rows, now)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._release(key, self._rows(), max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs()))
        if len(out):
            yield out

    def close(self) -> None:
        pass


def write_batches(
    events: DataFrame,
    value: Column,
    lane: Column | None = None,
    size: int = SIZE,
    wait_ms: int = WAIT_MS,
    by_clock: bool = True,
    delay: str = "10 seconds",
) -> DataFrame:
    """lane, batch, size, event_id, value of a stream of (event_id, event_time, ...).

    By the clock a batch is out ``wait_ms`` after its first row came, or with the next trigger
    after that. By event time it is out when the watermark (``delay`` behind) has passed it.
    """
    if not by_clock:
        events = events.withWatermark("event_time", delay)
    lane = F.pmod(F.xxhash64("event_id"), F.lit(LANES)) if lane is None else lane
    lane = lane.cast("int").alias("lane")
    kept = [] if by_clock else ["event_time"]
    rows = events.select(lane, F.unix_millis("event_time").alias("ms"), "event_id", value.alias("value"), *kept)
    return rows.groupBy("lane").transformWithStateInPandas(
        WriteBatches(size, wait_ms, by_clock),
        "lane int, batch bigint, size int, event_id string, value string",
        "Append",
        "ProcessingTime" if by_clock else "EventTime",
    )
