"""Windowed aggregates on the scored stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.plans import hourly, queries
from tidewarden.plans.queries import _anomalies, _rate_pct
from tidewarden.session import cut_lineage
from tidewarden.sources import files, sinks

LATE = "3 hours"
PIECE_ROWS = 1_000_000


def hourly_stream(scored: DataFrame, late: str = LATE) -> DataFrame:
    """Hourly partials per source; events up to 3 hours late still count."""
    return hourly.hourly_partials(scored.withWatermark("event_time", late))


def ingestion_stream(scored: DataFrame, late: str = LATE) -> DataFrame:
    """Events per second and anomaly rate in 10-second windows."""
    return (
        scored.withWatermark("event_time", late)
        .groupBy(F.window("event_time", "10 seconds").alias("w"))
        .agg((F.count("*") / F.lit(10.0)).alias("events_per_sec"), _rate_pct().alias("anomaly_rate_pct"))
        .select(F.col("w.start").alias("time"), "events_per_sec", "anomaly_rate_pct")
    )


def live_metrics_stream(scored: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per second over 10 s and anomaly rate over 5 min, at every 5-second tick.

    Events are reduced to 5-second cells first; only the cells are copied into the
    60 windows that cover them. Runs in append mode: a tick comes out once the
    watermark has passed it.
    """
    cells = (
        scored.withWatermark("event_time", late)
        .groupBy(F.window("event_time", "5 seconds").alias("cell"))
        .agg(F.count("*").alias("n"), _anomalies().alias("a"))
    )
    newest = F.col("start") >= F.col("w.end") - F.expr("INTERVAL 10 SECONDS")
    return (
        cells.select(
            F.col("cell.start").alias("start"), "n", "a",
            F.window("cell", "5 minutes", "5 seconds").alias("w"),
        )
        .groupBy("w")
        .agg(
            F.round(F.sum(F.when(newest, F.col("n")).otherwise(0)) / F.lit(10.0), 2).alias(
                "events_per_second"
            ),
            F.round(F.lit(100.0) * F.sum("a") / F.sum("n"), 2).alias("anomaly_rate_percent"),
        )
        .select(F.col("w.end").alias("tick"), "events_per_second", "anomaly_rate_percent")
    )


def clock_stream(spark: SparkSession) -> DataFrame:
    """The clock as a stream: one row per second (``at``), whether events come in or not."""
    return (
        spark.readStream.format("rate").option("rowsPerSecond", "1").load()
        .select(F.date_trunc("second", "timestamp").alias("at"))
    )


def start_by_clock(
    clock: DataFrame, evaluate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every_s: int,
    column: str, interval: str | None = None,
):
    """Write ``evaluate(ticks)`` for every tick of a clock, also where no event has come in.

    A stream of events stands still without events, so what has to be said about silence is driven
    by a stream of times. Seconds that are no multiple of ``every_s`` are passed over; ticks missed
    while the query was down are made up for. Each batch has a folder that a retry replaces.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        on_time = F.unix_seconds("at") % every_s == 0
        ticks = batch.filter(on_time).select(F.date_trunc("second", "at").alias(column))
        sinks.append_batch(evaluate(ticks), out, batch_id)

    writer = (
        clock.writeStream.queryName(f"clock-{column}").option("checkpointLocation", checkpoint).foreachBatch(judge)
    )
    return (
        writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    ).start()


def start_rate_rule(
    clock: DataFrame, events: Callable[[], DataFrame], out: str, checkpoint: str, every_s: int = 10,
    interval: str | None = None, **rule,
):
    """The anomaly-rate rule, judged every ``every_s`` seconds of the clock on the table as it is then."""
    return start_by_clock(
        clock, lambda ticks: queries.rate_rule_at(events(), ticks, **rule), out, checkpoint, every_s, "eval_time", interval
    )


def start_live_metrics(
    clock: DataFrame, events: Callable[[], DataFrame], out: str, checkpoint: str, every_s: int = 5,
    interval: str | None = None,
):
    """Live metrics every ``every_s`` seconds of the clock, zeros where no event came in."""
    return start_by_clock(
        clock, lambda ticks: queries.live_metrics_at(events(), ticks), out, checkpoint, every_s, "tick", interval
    )


def start_hourly(scored: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Keep the hourly table up to date: each batch replaces the rows it changed.

    Update mode emits the new value of every changed (hour, source). The batch is
    merged with what the touched hours hold, and those hours are overwritten.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            counts = batch.groupBy(F.date_format("bucket", "yyyyMMddHH").alias("hour")).count().collect()
            if not counts:
                return
            hours = [r["hour"] for r in counts]
            if files.exists(spark, path):
                held = hourly.read_partials(spark, path).filter(F.col("bucket_hour").isin(hours))
                kept = held.drop("bucket_hour").join(batch, ["bucket", "source_id"], "left_anti")
                # The rows are read from the folders about to be replaced.
                merged = cut_lineage(batch.unionByName(kept))
            else:
                merged = batch
            # Plans of a stateful stream are not adaptive: without this every task has a file in every hour.
            pieces = max(r["count"] for r in counts) // PIECE_ROWS + 1
            hourly.write_partials(merged, path, pieces)
        finally:
            batch.unpersist()

    writer = (
        hourly_stream(scored)
        .writeStream.queryName("hourly")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(merge)
    )
    return (
        writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    ).start()


def unique_stream(events: DataFrame, keys: list[str] = ("event_id", "event_time"), delay: str = "10 minutes") -> DataFrame:
    """The first of equal events, in front of a sink: repeats that come within ``delay`` never reach it.

    The state holds the keys of that time only; what comes later still is left to the sink's own
    comparison with the table.
    """
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys))
