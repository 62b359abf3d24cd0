"""Scored topic -> alerts table, alerts topic and notifications."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewarden.functions.severity import AlertThresholds
from tidewarden.functions.timebuckets import time_range
from tidewarden.operators import alerts, notify
from tidewarden.schema import BURST_WINDOW_MS, SCORED_EVENT
from tidewarden.sources import files, sinks


@dataclass
class Alerter:
    """Settings of an alerting query.

    ``silences``, ``clears`` and ``thresholds`` are called once per micro-batch,
    so new rules and overrides take effect with the next batch.
    """

    scored_table: str
    alert_table: str
    alert_topic: str | dict[str, str]
    notifications: str
    checkpoint: str
    silences: Callable[[], DataFrame] | None = None
    clears: Callable[[], DataFrame] | None = None
    thresholds: Callable[[], AlertThresholds] = AlertThresholds
    window_ms: int = BURST_WINDOW_MS
    chunk_ms: int = 600_000
    email_to: str = ""
    routing_key: str = ""


def context_files(spark: SparkSession, a: Alerter, batch_id: int, first: dt.date, last: dt.date) -> list[str]:
    """Files of the scored table, in the days given, that a micro-batch counts bursts on.

    The first attempt writes their names beside the checkpoint, before anything is counted, and a
    retry goes by that list: what was inserted in between is left out. Only when a compaction has
    taken a named file away does the retry read the days as they are. The lists of this batch and
    the one before are kept.
    """
    present = [
        f"{day}/{name}"
        for day in files.children(spark, a.scored_table)
        if f"event_date={first}" <= day <= f"event_date={last}"
        for name in files.children(spark, f"{a.scored_table}/{day}")
        if not name.startswith(("_", "."))
    ]
    folder = f"{a.checkpoint.rstrip('/')}-context"
    pin = f"{folder}/{batch_id}"
    if files.exists(spark, pin):
        named = [r.value for r in spark.read.text(pin).collect()]
        return named if set(named) <= set(present) else present
    # Moved into place whole: a list that was cut short is never read.
    files.write_text(spark, f"{folder}/_writing", "\n".join(present))
    files.move(spark, f"{folder}/_writing", pin)
    files.delete(spark, f"{folder}/{batch_id - 2}")
    return present


def alerts_of_batch(batch: DataFrame, batch_id: int, a: Alerter) -> DataFrame | None:
    """Alerts of the events of one micro-batch, None without any anomaly.

    Bursts are counted on the scored table, from one window before the batch to
    its end, so no state has to be carried or kept in memory for a source and late
    events are counted where they belong. A retry counts on the same files as the
    first attempt (``context_files``); silences, clears and thresholds are those of its time.
    """
    spark = batch.sparkSession
    ms = F.unix_millis("event_time")
    flagged = batch.filter("is_anomaly").select(
        "event_id", "source_id", F.floor(ms / F.lit(a.window_ms)).alias("slot"),
        F.unix_micros("event_time").alias("us"),
    )
    low, high = flagged.agg(F.min("us"), F.max("us")).first()
    if low is None:
        return None
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    start = epoch + dt.timedelta(microseconds=low) - dt.timedelta(milliseconds=a.window_ms)
    end = epoch + dt.timedelta(microseconds=high)
    # What counts for an event lies in its own slot of one window width or the one
    # before, so a single late event does not pull in all sources since then.
    near = flagged.select(
        F.col("source_id").alias("_source"),
        F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("_slot"),
    ).distinct()
    held = context_files(spark, a, batch_id, start.date(), end.date())
    if held:
        reader = spark.read.schema(SCORED_EVENT).option("basePath", a.scored_table)
        context = reader.parquet(*[f"{a.scored_table}/{name}" for name in held])
    else:
        context = spark.createDataFrame([], SCORED_EVENT)
    context = time_range(context, start, end).filter("is_anomaly").join(
        near,
        (F.col("source_id") == F.col("_source"))
        & (F.floor(ms / F.lit(a.window_ms)) == F.col("_slot")),
        "left_semi",
    )
    built = alerts.build_alerts(
        context,
        a.silences() if a.silences else None,
        a.thresholds(),
        a.clears() if a.clears else None,
        a.window_ms,
        a.chunk_ms,
    )
    return built.join(flagged.select("event_id"), "event_id", "left_semi")


def alert_batch(batch: DataFrame, batch_id: int, a: Alerter) -> None:
    found = alerts_of_batch(batch, batch_id, a)
    if found is None:
        return
    found = found.persist()
    try:
        sinks.write_alerts(found, a.alert_table, a.alert_topic, batch_id)
        sinks.append_batch(
            notify.notifications(found, a.email_to, a.routing_key), a.notifications, batch_id
        )
    finally:
        found.unpersist()


def start_alerting(
    scored: DataFrame, a: Alerter, interval: str | None = None
) -> StreamingQuery:
    """Alert on a scored stream (the topic, not the table, which compaction rewrites)."""
    writer = (
        scored.writeStream.queryName("alerting")
        .option("checkpointLocation", a.checkpoint)
        .foreachBatch(lambda df, batch_id: alert_batch(df, batch_id, a))
    )
    return (
        writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    ).start()
