"""The physical plans are the ones the design relies on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from registered.common import scored as scored_view
from registered.common import table
from tidewarden.operators import alerts, features, half_space
from tidewarden.plans import queries, retrain
from tidewarden.session import shared_dir
from tidewarden.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()  # the adaptive plan is final after a run
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    path = shared_dir(spark, "plans")
    e = scored_view(spark, SF).withColumn("severity", F.lit("LOW"))
    sinks.insert_new(e.withColumn("metadata", F.create_map().cast("map<string,string>")), path)
    return path


def test_time_range_prunes_days_and_columns(spark, stored):
    start, end = dt.datetime(2024, 1, 5, tzinfo=dt.UTC), dt.datetime(2024, 1, 6, 12, tzinfo=dt.UTC)
    text = plan(queries.heatmap(readers.scored_table(spark, stored), "1h", start, end))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(event_date" in scan and "2024-01-05" in scan
    assert "GreaterThanOrEqual(event_time" in scan
    assert "features" not in scan.split("ReadSchema")[1]
    days = {r.event_date for r in readers.scored_table(spark, stored, start, end).collect()}
    assert days == {dt.date(2024, 1, 5), dt.date(2024, 1, 6)}


def test_newest_time_reads_one_day(spark, stored):
    from tidewarden.functions.timebuckets import latest_time

    assert readers.newest_time(spark, stored) == latest_time(scored_view(spark, SF))
    assert readers.newest_time(spark, shared_dir(spark, "none")) is None


def test_top_k_plans(spark, stored):
    e = readers.scored_table(spark, stored)
    assert "TakeOrderedAndProject" in plan(queries.list_events(e, 10, 5))
    built = alerts.build_alerts(e).select("alert_id", "source_id")
    text = plan(queries.alert_details(built, e))
    assert text.count("WindowGroupLimit") >= 2


def test_no_nested_loops(spark):
    e = scored_view(spark, SF)
    rules = alerts.effective_silences(
        alerts.silence_rows(
            e.select("source_id", F.lit(5).alias("duration_minutes"), F.lit("x").alias("reason"),
                     F.col("event_time").alias("created_at"))
        )
    )
    frames = [
        alerts.build_alerts(e, rules),
        features.with_rolling(e.withColumn("v", F.col("feature_vector")[1]), "v"),
        features.with_return(e.withColumn("v", F.col("feature_vector")[1]), "v"),
        half_space.batch_scores(e, "source_id", "feature_vector", 2),
        queries.rate_rule(e),
        retrain.newest_rows(e, 10),
    ]
    for df in frames:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_sweep_takes_one_shuffle(spark):
    e = scored_view(spark, SF).filter("is_anomaly").select("event_id", "source_id", "event_time", "anomaly_score")
    text = alerts.burst_counts(e)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    v = table(spark, SF, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("source_id"),
        F.col("ts").cast("timestamp").alias("event_time"), "value",
    )
    text = features.with_rolling(v, "value")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_aggregates_combine_before_the_shuffle(spark, stored):
    e = readers.scored_table(spark, stored)
    for df in (queries.heatmap(e), queries.top_sources(e), queries.source_summary(e)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("HashAggregate") >= 2
