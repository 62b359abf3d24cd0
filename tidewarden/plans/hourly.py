"""Hourly per-source aggregate: build, incremental refresh, real-time read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.timebuckets import bucket, latest_time, literal_ts, time_range


def hourly_partials(events: DataFrame) -> DataFrame:
    """Partials per hour and source: count, sum and max (the mean is derived)."""
    return (
        events.groupBy(bucket(F.col("event_time"), 3_600).alias("w"), "source_id")
        .agg(
            F.count("*").alias("event_count"),
            F.sum("anomaly_score").alias("score_sum"),
            F.max("anomaly_score").alias("max_score"),
        )
        .select(F.col("w.start").alias("bucket"), "source_id", "event_count", "score_sum", "max_score")
    )


def finish(partials: DataFrame) -> DataFrame:
    return partials.select(
        "bucket",
        "source_id",
        "event_count",
        (F.col("score_sum") / F.col("event_count")).alias("avg_score"),
        "max_score",
    )


def hourly_stats(events: DataFrame) -> DataFrame:
    return finish(hourly_partials(events))


def refresh_range(
    as_of: dt.datetime, look_back_h: int = 3, hold_h: int = 1
) -> tuple[dt.datetime, dt.datetime]:
    """Whole hours inside [as_of - look_back, as_of - hold)."""
    hour = dt.timedelta(hours=1)

    def ceil(t: dt.datetime) -> dt.datetime:
        base = t.replace(minute=0, second=0, microsecond=0)
        return base if base == t else base + hour

    start = ceil(as_of - look_back_h * hour)
    end = (as_of - hold_h * hour).replace(minute=0, second=0, microsecond=0)
    return start, end


def write_partials(partials: DataFrame, path: str, pieces: int | None = None) -> None:
    """Replace exactly the hour partitions present in ``partials``.

    An hour is written by few tasks, not by all of them. ``pieces``: by that many, for callers
    whose plans are not adaptive (the hint is passed over there); None leaves it to AQE.
    """
    hours = partials.withColumn("bucket_hour", F.date_format("bucket", "yyyyMMddHH"))
    if pieces:
        gathered = hours.repartition("bucket_hour", F.pmod(F.hash("source_id"), F.lit(pieces)))
    else:
        # One hour of one-row-per-source partials; large hours are split by AQE.
        gathered = hours.hint("rebalance", F.col("bucket_hour"))
    (
        gathered.write.partitionBy("bucket_hour")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def refresh(
    events: DataFrame, path: str, as_of: dt.datetime | None = None, full: bool = False
) -> tuple[dt.datetime, dt.datetime] | None:
    """Recompute the buckets the policy covers; ``full`` builds all closed ones."""
    as_of = as_of or latest_time(events)
    start, end = refresh_range(as_of)
    if full:
        write_partials(hourly_partials(time_range(events, end=end, end_open=True)), path)
        return None
    write_partials(hourly_partials(time_range(events, start, end, end_open=True)), path)
    return start, end


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "bucket timestamp, source_id string, event_count bigint, score_sum double, "
        "max_score double, bucket_hour string"
    ).parquet(path)


def realtime(events: DataFrame, materialised: DataFrame) -> DataFrame:
    """Materialised buckets plus a live aggregate of everything newer."""
    newest = materialised.agg(F.max(F.unix_seconds("bucket"))).first()[0]
    if newest is None:
        return hourly_stats(events)
    edge = dt.datetime.fromtimestamp(newest, dt.UTC) + dt.timedelta(hours=1)
    stored = materialised.filter(F.col("bucket") < literal_ts(edge)).drop("bucket_hour")
    return finish(stored.unionByName(hourly_partials(time_range(events, edge))))
