"""Retraining: choose the rows, fit, evaluate, store, and move the pointer if it helps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.timebuckets import latest_time, time_range
from tidewarden.operators import evaluate, features, forest
from tidewarden.sources.registry import Registry, should_promote, version_stamp


def newest_rows(df: DataFrame, n: int, tie: str = "event_id") -> DataFrame:
    """The newest ``n`` rows, without a top-n of the whole table in every task.

    Counts per minute (bounded by the time span) give the minute in which the
    n-th newest row lies; only rows from that minute on are sorted.
    """
    per_minute = df.groupBy(
        F.floor(F.unix_seconds("event_time") / F.lit(60)).alias("minute")
    ).agg(F.count("*").alias("rows"))
    newer = Window.orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        per_minute.withColumn("total", F.sum("rows").over(newer))
        .filter(F.col("total") >= n)
        .agg(F.max("minute"))
        .first()[0]
    )
    if edge is None:
        return df
    start = dt.datetime.fromtimestamp(edge * 60, dt.UTC)
    return time_range(df, start).orderBy(F.desc("event_time"), tie).limit(n)


def recent(events: DataFrame, as_of: dt.datetime | None = None, days: int = 30) -> DataFrame:
    as_of = as_of or latest_time(events)
    return time_range(events, as_of - dt.timedelta(days=days), start_open=True)


def recent_count(events: DataFrame, as_of: dt.datetime | None = None, days: int = 30) -> DataFrame:
    """How many events the last days hold."""
    return recent(events, as_of, days).agg(F.count("*").alias("events"))


def training_set(
    events: DataFrame,
    as_of: dt.datetime | None = None,
    days: int = 30,
    newest: int = 100_000,
    at_least: int = 1000,
) -> DataFrame | None:
    """The newest rows of the last days, or None if there are too few."""
    rows = recent(events, as_of, days)
    if rows.limit(at_least).count() < at_least:
        return None
    return newest_rows(rows, newest)


def retrain(
    registry: Registry,
    events: DataFrame,
    as_of: dt.datetime | None = None,
    vector: str = "feature_vector",
    names: list[str] | None = None,
    skewed: list[str] = (),
    labels: DataFrame | None = None,
    trees: int = 100,
    contamination: float = 0.1,
    newest: int = 100_000,
    at_least: int = 1000,
    metric: str = "f1",
) -> str | None:
    """One retraining run; returns its version, or None when it was skipped.

    With ``names`` the model learns those features of the ``features`` map, the ``skewed`` ones
    after log1p; infinite and missing values count as the mean. Without, it learns the positions
    of ``vector`` under the names f0, f1, ... Either way the scaler stores the names, and events
    are scored by name. One version names the scaler, the forest and the run. With ``labels``
    (event_id, label 0/1) the run is scored on ``metric`` and only promoted if it
    is not worse than the active version.
    """
    as_of = as_of or latest_time(events)
    rows = training_set(events, as_of, newest=newest, at_least=at_least)
    if rows is None:
        return None
    rows = rows.select("event_id", F.col("features" if names else vector).alias("x")).persist()
    version = version_stamp(as_of)
    try:
        if names:
            scaler = features.fit_scaler(rows, list(names), list(skewed), version, features="x")
            z = features.scaled_vector(F.col("x"), scaler)
        else:
            width = rows.agg(F.max(F.size("x"))).first()[0]
            mean, std = features.vector_moments(rows, "x", width)
            scaler = features.Scaler(version, [f"f{i}" for i in range(width)], mean, std)
            z = scale_vector("x", scaler)
        width = len(scaler.names)
        scaled = rows.select("event_id", z.alias("z")).persist()
        model = forest.fit(scaled, "z", "event_id", version, trees, contamination)
        scored = scaled.withColumn("decision", forest.decide(model, F.col("z"))).persist()
        summary = evaluate.fit_summary(scored).first().asDict()
        if labels is not None:
            judged = scored.join(labels, "event_id").select(
                forest.raw_flag(F.col("decision")).alias("flag"),
                forest.normalised(F.col("decision")).alias("score"),
                "label",
            )
            summary |= evaluate.classification(judged, "flag", "label").first().asDict()
            summary["roc_auc"] = evaluate.roc_auc(judged, "score", "label")
        scaled.unpersist()
        scored.unpersist()
    finally:
        rows.unpersist()
    spark = events.sparkSession
    previous = active_metric(registry, metric)
    registry.save("scaler", version, scaler.to_df(spark))
    registry.save("forest", version, model.to_df(spark))
    parameters = {
        "n_estimators": trees, "contamination": contamination, "random_state": 42,
        "n_features": width, "max_samples": "auto", "features": ",".join(scaler.names),
    }
    registry.log_run(version, "IsolationForest", parameters, summary, as_of)
    if metric not in summary or should_promote(summary[metric], previous):
        registry.activate(version, as_of)
    return version


def scale_vector(vector: str, scaler: features.Scaler):
    """Positional vector scaled with a fitted scaler; bad or missing values become 0."""
    return F.array(
        *[
            F.coalesce(
                (features.finite(F.get(vector, F.lit(i))) - F.lit(m)) / F.lit(s), F.lit(0.0)
            )
            for i, (m, s) in enumerate(zip(scaler.mean, scaler.scale))
        ]
    )


def active_metric(registry: Registry, metric: str) -> float | None:
    """Metric of the active version's run, if it has one."""
    row = (
        registry.runs()
        .filter(F.col("version") == registry.active())
        .select(F.col("metrics")[metric])
        .first()
    )
    return row[0] if row else None


def job_states(log: DataFrame) -> DataFrame:
    """Retraining jobs folded from their append-only log.

    ``log``: job_id, status, reason, force, at, error. The first entry creates the
    job; the newest sets its status; COMPLETED or FAILED ends it.
    """
    newest = F.struct("at", "status")
    return log.groupBy("job_id").agg(
        F.max_by("status", newest).alias("status"),
        F.min_by("reason", newest).alias("reason"),
        F.min_by("force", newest).alias("force"),
        F.min("at").alias("created_at"),
        F.max(F.when(F.col("status").isin("COMPLETED", "FAILED"), F.col("at"))).alias(
            "completed_at"
        ),
        F.max_by("error", newest).alias("error"),
    )
