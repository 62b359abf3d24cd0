"""Keyed state that no task has to hold alone: streams worked off by the skew-proof batch operators.

``streaming.keyed`` folds a key's rows of one trigger in one task. Here a micro-batch goes through the
batch form of the operator, which numbers rows and adds up without gathering a key, and starts from
what earlier batches left: burst events as rows, half-space trees as counts and sums that add. The
state is a table with one version per micro-batch, so a batch that is run again starts from the same
version and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewarden.functions.severity import AlertThresholds
from tidewarden.operators import alerts, half_space
from tidewarden.schema import BURST_WINDOW_MS
from tidewarden.sources import files, sinks

VERSION = "batch_id="


class Versions:
    """State tables by micro-batch; the newest two are kept, a retry needs no older one."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _ids(self) -> list[int]:
        names = files.children(self.spark, self.path)
        return sorted(int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION))

    def before(self, batch_id: int) -> DataFrame:
        """The state that micro-batch ``batch_id`` starts from."""
        older = [i for i in self._ids() if i < batch_id]
        if not older:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{VERSION}{older[-1]}")

    def write(self, state: DataFrame, batch_id: int) -> None:
        state.write.mode("overwrite").parquet(f"{self.path}/{VERSION}{batch_id}")
        for old in [i for i in self._ids() if i < batch_id][:-1]:
            files.delete(self.spark, f"{self.path}/{VERSION}{old}")


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return writer.trigger(availableNow=True).start()


# --- bursts ------------------------------------------------------------------------

BURST_ROWS = "source_id string, event_id string, event_time timestamp, anomaly_score double"


def burst_batch(
    batch: DataFrame, batch_id: int, versions: Versions, out: str, high: float, window_ms: int, storm: int
) -> None:
    """Counts of one micro-batch, written to ``out``; HIGH+ events of the last two windows stay."""
    names = [f.split()[0] for f in BURST_ROWS.split(", ")]
    new = batch.select(*names, F.lit(True).alias("_new"))
    both = versions.before(batch_id).withColumn("_new", F.lit(False)).unionByName(new).persist()
    try:
        counted = alerts.burst_counts(both, high, window_ms, max(600_000, 2 * window_ms), storm=storm)
        sinks.append_batch(counted.filter("_new").select("source_id", "event_id", "burst_count"), out, batch_id)
        newest = both.agg(F.max(F.unix_millis("event_time"))).first()[0]
        if newest is not None:
            recent = F.unix_millis("event_time") > F.lit(newest - 2 * window_ms)
            versions.write(both.filter((F.col("anomaly_score") >= high) & recent).select(*names), batch_id)
    finally:
        both.unpersist()


def start_bursts(
    anomalies: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    high: float = AlertThresholds().high,
    window_ms: int = BURST_WINDOW_MS,
    storm: int = alerts.STORM,
) -> StreamingQuery:
    """Burst counts of a stream, as ``alerts.burst_counts`` gives them over all its rows.

    Ties are broken by event id, whichever batch the events come in; what is two windows behind the
    newest event is no longer counted for late ones.
    """
    versions = Versions(anomalies.sparkSession, state, BURST_ROWS)
    return _start(anomalies, lambda df, i: burst_batch(df, i, versions, out, high, window_ms, storm), checkpoint)


# --- half-space trees ----------------------------------------------------------------


def half_space_batch(
    batch: DataFrame, batch_id: int, versions: Versions, out: str, key: str, vector: str, width: int,
    params: half_space.Params, given: tuple[np.ndarray, np.ndarray] | None,
) -> None:
    """Scores of one micro-batch, written to ``out``, and the state behind it."""
    rows = batch.select(F.col(key).cast("string").alias("key"), "event_id", "event_time", F.col(vector).alias("x"))
    rows = rows.persist()
    try:
        state = versions.before(batch_id)
        scored, after = half_space.continued(rows, "key", "x", width, state, params=params, given=given)
        sinks.append_batch(scored, out, batch_id)
        versions.write(after, batch_id)
    finally:
        rows.unpersist()


def start_half_space(
    events: DataFrame, out: str, state: str, checkpoint: str, key: str, vector: str, width: int,
    params: half_space.Params = half_space.Params(), given: tuple[np.ndarray, np.ndarray] | None = None,
) -> StreamingQuery:
    """Half-space scores of a stream; a key's rows of a micro-batch spread over tasks by windows."""
    versions = Versions(events.sparkSession, state, half_space.STATE)

    def work(df: DataFrame, i: int) -> None:
        half_space_batch(df, i, versions, out, key, vector, width, params, given)

    return _start(events, work, checkpoint)
