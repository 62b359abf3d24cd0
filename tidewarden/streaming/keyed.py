"""Stateful operators on a stream: bursts, half-space trees, Page-Hinkley.

Rows of a micro-batch are put in time order per key before they are folded in; a
row that comes in a later batch than a newer one is folded when it arrives. How
many rows one key can bring is bounded by the source's rate limit per trigger; for keys
beyond what one task can take there are the forms of ``streaming.mergeable``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewarden.functions.severity import AlertThresholds
from tidewarden.operators import drift, half_space
from tidewarden.schema import BURST_WINDOW_MS

SLACK_MS = 10_000
BUCKETS = 512  # of sources, by hash; fixed for the life of a checkpoint


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ms", "event_id"])


def burst_counts(held: np.ndarray, ms: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """HIGH+ rows in (t - window, t] up to each row; ``held`` are earlier ones, all sorted.

    A row counts only what lies before it in time (or beside it, and earlier in the order), so a
    late row neither counts newer rows nor hides older ones.
    """
    old = np.searchsorted(held, ms, "right") - np.searchsorted(held, ms - window, "right")
    upto = np.concatenate([[0], np.cumsum(high)])
    return old + upto[1:] - upto[np.searchsorted(ms, ms - window, "right")]


class Bursts(StatefulProcessor):
    """Times of the HIGH+ events of the last window, sorted, for every source of a bucket.

    A bucket is called once per micro-batch, whatever the number of its sources: a call for each
    source would cost far more than its few rows. The sources of a bucket do not see each other.

    With ``expire`` a timer drops a source once the watermark is a window and ``SLACK_MS`` past
    the newest of its times: no event that may still come can count them.
    """

    def __init__(self, high: float, window_ms: int, expire: bool):
        self.high, self.window_ms, self.expire = high, window_ms, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "source_id string, times binary")

    def _held(self) -> dict[str | None, np.ndarray]:
        rows = self.seen.get() if self.seen.exists() else []
        return {source: np.frombuffer(bytes(times), "<i8") for source, times in rows}

    def _hold(self, held: dict[str | None, np.ndarray], now: int) -> None:
        """Keep what is not over at ``now``, with a timer on the first source to be over."""
        ends = {}
        if self.expire:
            ends = {source: int(times[-1]) + self.window_ms + SLACK_MS for source, times in held.items()}
            held = {source: times for source, times in held.items() if ends[source] > now}
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held:
            self.seen.put([(source, times.tobytes()) for source, times in held.items()])
        else:
            self.seen.clear()
        if self.expire and held:
            self.handle.registerTimer(min(ends[source] for source in held))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, held = _in_order(rows), self._held()
        at, score = pdf["ms"].to_numpy(), (pdf["anomaly_score"] >= self.high).to_numpy()
        codes, names = pd.factorize(pdf["source_id"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")  # within a source the order of time stays
        counts = np.zeros(len(pdf), "int64")
        for name, own in zip(names, np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)):
            source = None if pd.isna(name) else name
            ms, high = at[own].astype("<i8"), score[own]
            old = held.pop(source, np.zeros(0, "<i8"))
            counts[own] = burst_counts(old, ms, high, self.window_ms)
            old = np.sort(np.concatenate([old, ms[high]]))
            newest = max(ms[-1], old[-1]) if len(old) else ms[-1]
            # Late rows may still need what is a window older than the newest event.
            old = old[old > newest - 2 * self.window_ms]
            if len(old):
                held[source] = old.astype("<i8")
        self._hold(held, timerValues.getCurrentWatermarkInMs() if self.expire else 0)
        yield pd.DataFrame({"source_id": pdf["source_id"], "event_id": pdf["event_id"], "burst_count": counts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._hold(self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        return iter([])

    def close(self) -> None:
        pass


def burst_stream(
    anomalies: DataFrame,
    high: float = AlertThresholds().high,
    window_ms: int = BURST_WINDOW_MS,
    expire: bool = False,
) -> DataFrame:
    """Burst count of every unsilenced anomaly as it arrives.

    With ``expire`` the state of a source goes by event time, so it does in a replay as well;
    events that come more than ``SLACK_MS`` behind the newest one of earlier batches are then late
    and left out.
    """
    rows = anomalies.withWatermark("event_time", f"{SLACK_MS} milliseconds") if expire else anomalies
    kept = ["event_time"] if expire else []
    return (
        rows.select(
            F.pmod(F.xxhash64("source_id"), F.lit(BUCKETS)).alias("bucket"),
            "source_id", "event_id", F.unix_millis("event_time").alias("ms"), "anomaly_score", *kept,
        )
        .groupBy("bucket")
        .transformWithStateInPandas(
            Bursts(high, window_ms, expire),
            "source_id string, event_id string, burst_count bigint",
            "Append",
            "EventTime" if expire else "None",
        )
    )


class HalfSpace(StatefulProcessor):
    """Score, then learn; the state is the scaler sums and the node counts."""

    def __init__(self, width: int, params: half_space.Params, given=None):
        self.width, self.params, self.given = width, params, given

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trees = self.given or half_space.grow(self.width, self.params)
        self.state = handle.getValueState(
            "model", "n bigint, sums binary, current binary, reference binary"
        )

    def _load(self, first: np.ndarray) -> half_space.State:
        if not self.state.exists():
            return half_space.State.start(first, self.params)
        n, sums, current, reference = self.state.get()
        c, s1, s2 = np.frombuffer(bytes(sums), dtype="<f8").reshape(3, -1).copy()
        shape = (self.params.trees, self.params.nodes)
        masses = [
            np.frombuffer(bytes(b), dtype="<i4").reshape(shape).astype(float)
            for b in (current, reference)
        ]
        return half_space.State(int(n), c, s1, s2, *masses)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        x = np.vstack(pdf["x"].to_numpy()).astype(float)
        s = self._load(x[0])
        position = s.n + np.arange(len(x))
        scores = half_space.fold(s, x, self.trees, self.params)
        self.state.update(
            (
                s.n,
                np.stack([s.centre, s.s1, s.s2]).astype("<f8").tobytes(),
                s.current.astype("<i4").tobytes(),
                s.reference.astype("<i4").tobytes(),
            )
        )
        yield pd.DataFrame(
            {"key": key[0], "event_id": pdf["event_id"], "position": position, "score": scores}
        )

    def close(self) -> None:
        pass


def half_space_stream(
    events: DataFrame, key: str, vector: str, width: int,
    params: half_space.Params = half_space.Params(), given=None,
) -> DataFrame:
    return (
        events.select(
            F.col(key).cast("string").alias("key"), "event_id",
            F.unix_millis("event_time").alias("ms"), F.col(vector).alias("x"),
        )
        .groupBy("key")
        .transformWithStateInPandas(
            HalfSpace(width, params, given),
            "key string, event_id string, position bigint, score double",
            "Append",
            "None",
        )
    )


class PageHinkley(StatefulProcessor):
    """Drift signals of one detector; the state is six numbers."""

    FIELDS = ("n", "total", "up", "down", "up_min", "down_max")

    def __init__(self, params: drift.Params):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "detector",
            "n bigint, total double, up double, down double, up_min double, down_max double",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        s = drift.State(*self.state.get()) if self.state.exists() else drift.State()
        s, hits = drift.fold(s, pdf["x"].to_numpy("float64"), self.params)
        self.state.update(tuple(getattr(s, f) for f in self.FIELDS))
        at = pdf.iloc[hits]
        yield pd.DataFrame({"key": key[0], "event_id": at["event_id"], "ms": at["ms"], "x": at["x"]})

    def close(self) -> None:
        pass


def drift_stream(
    events: DataFrame, key: str, value: str, params: drift.Params = drift.Params()
) -> DataFrame:
    return (
        events.select(
            F.col(key).cast("string").alias("key"), "event_id",
            F.unix_millis("event_time").alias("ms"), F.col(value).cast("double").alias("x"),
        )
        .groupBy("key")
        .transformWithStateInPandas(
            PageHinkley(params), "key string, event_id string, ms bigint, x double", "Append", "None"
        )
    )
