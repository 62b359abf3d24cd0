"""Read-side queries on the scored-event table.

Every function takes DataFrames and returns a DataFrame. ``as_of`` replaces the
wall clock; where it is left out it is the newest event time. Ties in time are
broken by ``event_id`` so that paging is stable.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.severity import in_severity_range
from tidewarden.functions.timebuckets import (
    bucket,
    latest_time,
    literal_ts,
    resolution_seconds,
    time_range,
)

EVENT_COLUMNS = [
    "event_id",
    "event_time",
    "source_id",
    "feature_vector",
    "anomaly_score",
    "is_anomaly",
    "model_version",
    "processed_at",
]


def _anomalies() -> Column:
    return F.count_if(F.col("is_anomaly"))


def _rate_pct(digits: int | None = 2) -> Column:
    """Share of anomalies in percent, null for an empty set."""
    rate = F.lit(100.0) * _anomalies() / F.nullif(F.count("*"), F.lit(0))
    return rate if digits is None else F.round(rate, digits)


def _page(df: DataFrame, limit: int, offset: int, time_column: str, tie: str) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if offset < 0:
        raise ValueError("offset must not be negative")
    ordered = df.orderBy(F.desc(time_column), tie)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


# --- event lists -------------------------------------------------------------


def list_events(
    events: DataFrame,
    limit: int = 50,
    offset: int = 0,
    only_anomalies: bool = False,
    source_id: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    after: tuple[dt.datetime, str] | None = None,
) -> DataFrame:
    """Newest events first, with flag, source and time filters.

    ``offset`` costs as many rows as it skips. For deep paging give the time and
    id of the last row of the page before as ``after``: the page then starts
    behind it, and everything newer is pruned.
    """
    df = time_range(events, start, end)
    if after is not None:
        at, last_id = after
        older = F.col("event_time") < literal_ts(at)
        tied = (F.col("event_time") == literal_ts(at)) & (F.col("event_id") > last_id)
        df = time_range(df, end=at).filter(older | tied)
    if only_anomalies:
        df = df.filter("is_anomaly")
    if source_id:
        df = df.filter(F.col("source_id") == source_id)
    return _page(df, limit, offset, "event_time", "event_id").select(*EVENT_COLUMNS)


def list_anomalies(
    events: DataFrame,
    min_score: float | None = None,
    severity: str | None = None,
    source_id: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Newest anomalies first, also by lowest score and severity range."""
    df = events
    if min_score is not None:
        df = df.filter(F.col("anomaly_score") >= min_score)
    if severity:
        df = df.filter(in_severity_range(F.col("anomaly_score"), severity))
    return list_events(df, limit, offset, True, source_id, start, end)


def recent_events(
    events: DataFrame,
    limit: int = 50,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Newest events in a time window, flagged or not."""
    df = events
    if severity:
        df = df.filter(in_severity_range(F.col("anomaly_score"), severity))
    return list_events(df, limit, start=start, end=end)


def events_of_source(
    events: DataFrame, source_id: str, limit: int = 50, offset: int = 0
) -> DataFrame:
    """All events of one source, newest first."""
    return list_events(events, limit, offset, source_id=source_id)


def event_by_id(events: DataFrame, event_id: str, anomaly_only: bool = False) -> DataFrame:
    df = events.filter(F.col("event_id") == event_id)
    return (df.filter("is_anomaly") if anomaly_only else df).select(*EVENT_COLUMNS)


def latest_anomalies(
    events: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    limit: int = 100,
) -> DataFrame:
    df = time_range(events, start, end).filter("is_anomaly")
    return _page(df, limit, 0, "event_time", "event_id").select(
        "event_id", "event_time", "source_id", "anomaly_score", "processed_at"
    )


def score_scatter(
    events: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """Time, score and source of every event in a range, in time order."""
    return (
        time_range(events, start, end)
        .select("event_time", "anomaly_score", "source_id")
        .orderBy("event_time", "source_id")
    )


# --- aggregates over a range ---------------------------------------------------


def _summary(df: DataFrame, window_minutes: int) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_events"),
        F.coalesce(_anomalies(), F.lit(0)).alias("anomaly_count"),
        F.coalesce(F.avg("anomaly_score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.max("anomaly_score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(_rate_pct(), F.lit(0.0)).alias("anomaly_rate_pct"),
    ).select(F.lit(window_minutes).alias("window_minutes"), "*")


def window_stats(
    events: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """Totals, rate, mean and top score of a range; the last 24 hours by default."""
    end = end or latest_time(events)
    start = start or end - dt.timedelta(days=1)
    minutes = int((end - start).total_seconds() / 60)
    return _summary(time_range(events, start, end), minutes)


def rolling_stats(
    events: DataFrame, window_minutes: int = 60, as_of: dt.datetime | None = None
) -> DataFrame:
    """The same for the last N minutes; the lower bound is open, there is no upper."""
    if not 1 <= window_minutes <= 10_080:
        raise ValueError("window_minutes must be between 1 and 10080")
    as_of = as_of or latest_time(events)
    start = as_of - dt.timedelta(minutes=window_minutes)
    return _summary(time_range(events, start, start_open=True), window_minutes)


def heatmap(
    events: DataFrame,
    resolution: str = "1h",
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """Time bucket x source; the last 7 days by default."""
    end = end or latest_time(events)
    start = start or end - dt.timedelta(days=7)
    return (
        time_range(events, start, end)
        .groupBy(bucket(F.col("event_time"), resolution_seconds(resolution)).alias("w"), "source_id")
        .agg(
            F.count("*").alias("event_count"),
            _anomalies().alias("anomaly_count"),
            F.coalesce(F.avg("anomaly_score"), F.lit(0.0)).alias("avg_score"),
            F.coalesce(F.max("anomaly_score"), F.lit(0.0)).alias("max_score"),
        )
        .select(F.col("w.start").alias("bucket"), "source_id", "event_count", "anomaly_count",
                "avg_score", "max_score")
        .orderBy(F.desc("bucket"), "source_id")
    )


def bucketed_rate(
    events: DataFrame, resolution: str = "1h", source_id: str | None = None, buckets: int = 100
) -> DataFrame:
    """Event count and mean score per bucket, newest 100 buckets."""
    df = events.filter(F.col("source_id") == source_id) if source_id else events
    return (
        df.groupBy(bucket(F.col("event_time"), resolution_seconds(resolution)).alias("w"))
        .agg(F.count("*").alias("event_count"), F.avg("anomaly_score").alias("avg_score"))
        .select(F.col("w.start").alias("bucket"), "event_count", "avg_score")
        .orderBy(F.desc("bucket"))
        .limit(buckets)
    )


def ingestion_rate(
    events: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """Events per second in 10-second buckets."""
    return (
        time_range(events, start, end)
        .groupBy(bucket(F.col("event_time"), 10).alias("w"))
        .agg((F.count("*") / F.lit(10.0)).alias("events_per_sec"))
        .select(F.col("w.start").alias("time"), "events_per_sec")
        .orderBy("time")
    )


def anomaly_rate_series(
    events: DataFrame, as_of: dt.datetime | None = None, minutes: int = 5
) -> DataFrame:
    """Anomaly percentage per 10-second bucket over the last minutes."""
    as_of = as_of or latest_time(events)
    return (
        time_range(events, as_of - dt.timedelta(minutes=minutes))
        .groupBy(bucket(F.col("event_time"), 10).alias("w"))
        .agg(_rate_pct().alias("anomaly_rate_pct"))
        .select(F.col("w.start").alias("time"), "anomaly_rate_pct")
        .orderBy("time")
    )


def events_per_source(
    events: DataFrame, as_of: dt.datetime | None = None, hours: int = 1
) -> DataFrame:
    """Events per source in the last hour, busiest first."""
    as_of = as_of or latest_time(events)
    return (
        time_range(events, as_of - dt.timedelta(hours=hours))
        .groupBy("source_id")
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("event_count"), "source_id")
    )


def top_sources(
    events: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    limit: int = 10,
) -> DataFrame:
    """The sources with most anomalies and their mean score."""
    return (
        time_range(events, start, end)
        .filter("is_anomaly")
        .groupBy("source_id")
        .agg(
            F.count("*").alias("total_anomalies"),
            F.round(F.avg("anomaly_score"), 4).alias("avg_anomaly_score"),
        )
        .orderBy(F.desc("total_anomalies"), "source_id")
        .limit(limit)
    )


def active_model_version(events: DataFrame) -> DataFrame:
    """Version on the newest event."""
    newest = F.struct("event_time", "event_id")
    return events.agg(
        F.max("event_time").alias("time"),
        F.max_by("model_version", newest).alias("model_version"),
    )


def seed_check(events: DataFrame) -> DataFrame:
    """Row, anomaly and source counts."""
    return events.agg(
        F.count("*").alias("total"),
        _anomalies().alias("anomalies"),
        F.countDistinct("source_id").alias("sources"),
    )


def source_summary(events: DataFrame) -> DataFrame:
    """Totals, mean score and first and last day per source."""
    return (
        events.groupBy("source_id")
        .agg(
            F.count("*").alias("total"),
            _anomalies().alias("anomalies"),
            F.round(F.avg("anomaly_score"), 4).alias("avg_score"),
            F.min("event_time").cast("date").alias("oldest"),
            F.max("event_time").cast("date").alias("newest"),
        )
        .orderBy("source_id")
    )


def live_metrics(events: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Events per second over 10 s and anomaly percentage over 5 min."""
    as_of = as_of or latest_time(events)
    recent = time_range(events, as_of - dt.timedelta(minutes=5))
    last_10s = F.col("event_time") >= F.lit(as_of - dt.timedelta(seconds=10))
    return recent.agg(
        F.round(F.count_if(last_10s) / F.lit(10.0), 2).alias("events_per_second"),
        F.round(F.coalesce(_rate_pct(None), F.lit(0.0)), 2).alias("anomaly_rate_percent"),
    )


def live_metrics_series(events: DataFrame) -> DataFrame:
    """``live_metrics`` at every 5-second tick that has events in its 5 minutes.

    Counts are first reduced to 5-second cells; only the cells are copied into
    the 60 ticks that look back on them, never the events.
    """
    cells = events.groupBy(
        F.floor(F.unix_millis("event_time") / F.lit(5_000)).alias("cell")
    ).agg(F.count("*").alias("n"), _anomalies().alias("a"))
    # Tick k stands at k * 5 s and covers the cells k - 60 .. k - 1.
    back = F.explode(F.sequence(F.lit(1), F.lit(60))).alias("back")
    return (
        cells.select("cell", "n", "a", back)
        .groupBy((F.col("cell") + F.col("back")).alias("tick"))
        .agg(
            F.sum(F.when(F.col("back") <= 2, F.col("n")).otherwise(0)).alias("n10"),
            F.sum("n").alias("n"),
            F.sum("a").alias("a"),
        )
        .select(
            F.timestamp_seconds(F.col("tick") * 5).alias("tick"),
            F.round(F.col("n10") / F.lit(10.0), 2).alias("events_per_second"),
            F.round(F.lit(100.0) * F.col("a") / F.col("n"), 2).alias("anomaly_rate_percent"),
        )
    )


def live_metrics_at(events: DataFrame, ticks: DataFrame) -> DataFrame:
    """``live_metrics_series`` at the times in ``tick`` (multiples of 5 s); zeros where nothing came in.

    Only the events that the ticks look back on are read.
    """
    low, high = _span(ticks, "tick")
    near = time_range(events, low - dt.timedelta(minutes=5), high, end_open=True)
    known = live_metrics_series(near)
    return ticks.select("tick").distinct().join(known, "tick", "left").fillna(0.0)


def _span(ticks: DataFrame, column: str) -> tuple[dt.datetime, dt.datetime]:
    """First and last time of a column; the epoch twice for no rows."""
    at = F.unix_micros(column)
    return tuple(
        dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=us or 0)
        for us in ticks.agg(F.min(at), F.max(at)).first()
    )


def rate_rule(
    events: DataFrame,
    threshold_pct: float = 5.0,
    window_s: int = 120,
    hold_s: int = 120,
    every_s: int = 10,
) -> DataFrame:
    """Evaluations of the anomaly-rate rule: rate of the last 2 min > 5 %, held 2 min.

    Evaluation T covers [T - window, T). It fires once every evaluation from
    T - hold to T is above the threshold; a tick without events is not above.
    Events are reduced to one row per tick width before anything is copied, so
    the series is bounded by the time span, not by the number of events.
    """
    per_window = window_s // every_s
    per_hold = hold_s // every_s
    cells = events.groupBy(
        F.floor(F.unix_millis("event_time") / F.lit(every_s * 1_000)).alias("cell")
    ).agg(F.count("*").alias("n"), _anomalies().alias("a"))
    evaluations = (
        cells.select("n", "a", "cell", F.explode(F.sequence(F.lit(1), F.lit(per_window))).alias("b"))
        .groupBy((F.col("cell") + F.col("b")).alias("tick"))
        .agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
        .select(
            "tick",
            F.round(F.lit(100.0) * F.col("a") / F.col("n"), 2).alias("anomaly_rate"),
        )
        .withColumn("breach", F.col("anomaly_rate") > threshold_pct)
    )
    # A breach supports its own tick and the next hold/every ticks.
    held = (
        evaluations.select(
            "tick",
            "anomaly_rate",
            "breach",
            F.explode(F.sequence(F.lit(0), F.lit(per_hold))).alias("ahead"),
        )
        .groupBy((F.col("tick") + F.col("ahead")).alias("tick"))
        .agg(
            F.max(F.when(F.col("ahead") == 0, F.col("anomaly_rate"))).alias("anomaly_rate"),
            F.bool_or((F.col("ahead") == 0) & F.col("breach")).alias("breach"),
            F.count_if("breach").alias("breaches"),
        )
        .filter(F.col("anomaly_rate").isNotNull())
    )
    state = (
        F.when(~F.col("breach"), F.lit("Normal"))
        .when(F.col("breaches") == per_hold + 1, F.lit("Firing"))
        .otherwise(F.lit("Pending"))
    )
    return held.select(
        F.timestamp_seconds(F.col("tick") * every_s).alias("eval_time"),
        "anomaly_rate",
        state.alias("state"),
    )


def rate_rule_at(
    events: DataFrame, ticks: DataFrame, threshold_pct: float = 5.0, window_s: int = 120, hold_s: int = 120, every_s: int = 10
) -> DataFrame:
    """``rate_rule`` at the times in ``eval_time`` (multiples of ``every_s``), with or without events.

    A tick whose window holds no event has no rate and the state NoData, which also ends a hold.
    Only the events that the ticks look back on are read.
    """
    low, high = _span(ticks, "eval_time")
    near = time_range(events, low - dt.timedelta(seconds=window_s + hold_s), high, end_open=True)
    known = rate_rule(near, threshold_pct, window_s, hold_s, every_s)
    return ticks.select("eval_time").distinct().join(known, "eval_time", "left").fillna({"state": "NoData"})


# --- alerts and jobs -----------------------------------------------------------


def active_alert_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.col("status") == "ACTIVE").alias("active_alerts"))


def list_alerts(
    alerts: DataFrame,
    status: str | None = None,
    severity: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    df = alerts
    if status:
        df = df.filter(F.col("status") == status)
    if severity:
        df = df.filter(F.col("severity") == severity)
    return _page(df, limit, offset, "created_at", "alert_id")


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alert_count")).orderBy("severity")


def alert_details(alerts: DataFrame, events: DataFrame, newest: int = 10) -> DataFrame:
    """Each alert with the newest anomalies of its source, one row per pair.

    The anomalies are cut to ``newest`` per source before the join. The rank
    filter is applied on both sides of the shuffle, so a source that owns a
    third of all events sends only ``newest`` rows per task.
    """
    by_time = Window.partitionBy("source_id").orderBy(F.desc("event_time"), "event_id")
    linked = (
        events.filter("is_anomaly")
        .select("source_id", "event_time", "event_id", "anomaly_score")
        .withColumn("rank", F.row_number().over(by_time))
        .filter(F.col("rank") <= newest)
        .withColumnRenamed("event_id", "linked_event_id")
        .withColumnRenamed("event_time", "linked_event_time")
        .withColumnRenamed("anomaly_score", "linked_score")
    )
    return alerts.join(linked, "source_id", "left")


def alert_with_events(alerts: DataFrame, events: DataFrame, alert_id: str) -> DataFrame:
    """One alert and its linked anomalies as an array."""
    one = alerts.filter(F.col("alert_id") == alert_id)
    source = one.select("source_id").first()
    # The source is known, so the events are a filtered top-10, not a join.
    wanted = events.filter(F.lit(False)) if source is None else events.filter(
        F.col("source_id") == source[0]
    )
    linked = (
        wanted.filter("is_anomaly")
        .orderBy(F.desc("event_time"), "event_id")
        .limit(10)
        .groupBy("source_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("event_time", "event_id", "anomaly_score")), asc=False
            ).alias("linked_events")
        )
    )
    return one.join(linked, "source_id", "left")


def retrain_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest retraining jobs."""
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def retrain_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)
