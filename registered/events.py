"""Registered read-side queries, each next to its SQL twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registered.common import SCORED_SQL as S
from registered.common import scored
from tidewarden.plans import hourly, queries

QUERIES = {}
ORACLES = {}


def register(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def on_scored(name, fn, sql=None):
    register(name, lambda spark, sf: fn(scored(spark, sf)), sql)


def rounded(df, *names, digits=9):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


T0 = dt.datetime(2024, 1, 5, tzinfo=dt.UTC)
T1 = dt.datetime(2024, 1, 20, 12, tzinfo=dt.UTC)
RANGE = "event_time >= TIMESTAMP '2024-01-05 00:00:00' AND event_time <= TIMESTAMP '2024-01-20 12:00:00'"
ROW = "event_id, event_time, source_id, k, value, anomaly_score, is_anomaly, model_version, processed_at"
NEWEST = "(SELECT max(event_time) FROM scored)"
BUCKET = "time_bucket(INTERVAL '{}', event_time)"
AGGS = """count(*) AS event_count, CAST(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS anomaly_count,
  round(coalesce(avg(anomaly_score), 0.0), 9) AS avg_score, coalesce(max(anomaly_score), 0.0) AS max_score"""
RATE = "round(100.0::DOUBLE * sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) / nullif(count(*), 0), 2)"


def flat(df):
    """Feature array as two columns, so that results compare as plain values."""
    return df.select(
        "event_id", "event_time", "source_id",
        F.col("feature_vector")[0].alias("k"), F.col("feature_vector")[1].alias("value"),
        "anomaly_score", "is_anomaly", "model_version", "processed_at",
    )


on_scored(
    "q01_list_events",
    lambda e: flat(queries.list_events(e, limit=200, offset=30, start=T0, end=T1)),
    f"{S} SELECT {ROW} FROM scored WHERE {RANGE} ORDER BY event_time DESC, event_id LIMIT 200 OFFSET 30",
)
on_scored(
    "q02_event_by_id",
    lambda e: flat(queries.event_by_id(e, "42")),
    f"{S} SELECT {ROW} FROM scored WHERE event_id = '42'",
)
on_scored(
    "q03_list_anomalies",
    lambda e: flat(queries.list_anomalies(e, min_score=0.72, severity="low", limit=500, end=T1)),
    f"""{S} SELECT {ROW} FROM scored WHERE is_anomaly AND anomaly_score >= 0.72::DOUBLE
    AND anomaly_score >= 0.70::DOUBLE AND anomaly_score < 0.80::DOUBLE
    AND event_time <= TIMESTAMP '2024-01-20 12:00:00'
    ORDER BY event_time DESC, event_id LIMIT 500""",
)
SUMMARY = f"""count(*) AS total_events,
  CAST(coalesce(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END), 0) AS BIGINT) AS anomaly_count,
  round(coalesce(avg(anomaly_score), 0.0), 9) AS avg_score, coalesce(max(anomaly_score), 0.0) AS max_score,
  coalesce({RATE}, 0.0) AS anomaly_rate_pct"""
on_scored(
    "q04_window_stats",
    lambda e: rounded(queries.window_stats(e), "avg_score"),
    f"""{S} SELECT 1440 AS window_minutes, {SUMMARY} FROM scored
    WHERE event_time >= {NEWEST} - INTERVAL 1 DAY AND event_time <= {NEWEST}""",
)
on_scored(
    "q05_heatmap",
    lambda e: rounded(queries.heatmap(e, "1h"), "avg_score"),
    f"""{S} SELECT {BUCKET.format('1 hour')} AS bucket, source_id, {AGGS} FROM scored
    WHERE event_time >= {NEWEST} - INTERVAL 7 DAY AND event_time <= {NEWEST} GROUP BY 1, 2""",
)
for _res, _text in [("7d", "7 days"), ("2d", "2 days"), ("7m", "7 minutes")]:
    on_scored(
        f"q05_heatmap_{_res}",
        lambda e, _res=_res: rounded(queries.heatmap(e, _res, T0, T1), "avg_score"),
        f"""{S} SELECT {BUCKET.format(_text)} AS bucket, source_id, {AGGS} FROM scored
        WHERE {RANGE} GROUP BY 1, 2""",
    )
on_scored(
    "q06_rolling_stats",
    lambda e: rounded(queries.rolling_stats(e, 10_080), "avg_score"),
    f"""{S} SELECT 10080 AS window_minutes, {SUMMARY} FROM scored
    WHERE event_time > {NEWEST} - INTERVAL 10080 MINUTE""",
)
HOURLY = f"""{S} SELECT {BUCKET.format('1 hour')} AS bucket, source_id, count(*) AS event_count,
  round(avg(anomaly_score), 9) AS avg_score, max(anomaly_score) AS max_score FROM scored GROUP BY 1, 2"""
on_scored("q07_hourly_stats", lambda e: rounded(hourly.hourly_stats(e), "avg_score"), HOURLY)
on_scored(
    "q10_bucketed_rate",
    lambda e: rounded(queries.bucketed_rate(e, "1h"), "avg_score"),
    f"""{S} SELECT {BUCKET.format('1 hour')} AS bucket, count(*) AS event_count,
    round(avg(anomaly_score), 9) AS avg_score FROM scored GROUP BY 1 ORDER BY 1 DESC LIMIT 100""",
)
on_scored(
    "q11_recent_events",
    lambda e: flat(queries.recent_events(e, 100, T0, T1)),
    f"{S} SELECT {ROW} FROM scored WHERE {RANGE} ORDER BY event_time DESC, event_id LIMIT 100",
)
on_scored(
    "q12_events_of_source",
    lambda e: flat(queries.events_of_source(e, "7", 50, 5)),
    f"""{S} SELECT {ROW} FROM scored WHERE source_id = '7'
    ORDER BY event_time DESC, event_id LIMIT 50 OFFSET 5""",
)
on_scored(
    "q13_ingestion_rate",
    lambda e: queries.ingestion_rate(e),
    f"""{S} SELECT {BUCKET.format('10 seconds')} AS time, count(*) / 10.0::DOUBLE AS events_per_sec
    FROM scored GROUP BY 1""",
)
on_scored(
    "q14_anomaly_rate_series",
    lambda e: queries.anomaly_rate_series(e, minutes=43_200),
    f"""{S} SELECT {BUCKET.format('10 seconds')} AS time, {RATE} AS anomaly_rate_pct FROM scored
    WHERE event_time >= {NEWEST} - INTERVAL 43200 MINUTE GROUP BY 1""",
)
on_scored(
    "q16_events_per_source",
    lambda e: queries.events_per_source(e, hours=48),
    f"""{S} SELECT source_id, count(*) AS event_count FROM scored
    WHERE event_time >= {NEWEST} - INTERVAL 48 HOUR GROUP BY 1""",
)
on_scored(
    "q17_score_scatter",
    lambda e: queries.score_scatter(e, T0, T1),
    f"{S} SELECT event_time, anomaly_score, source_id FROM scored WHERE {RANGE}",
)
on_scored(
    "q18_top_sources",
    lambda e: queries.top_sources(e, T0, T1),
    f"""{S} SELECT source_id, count(*) AS total_anomalies, round(avg(anomaly_score), 4) AS avg_anomaly_score
    FROM scored WHERE is_anomaly AND {RANGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
on_scored(
    "q19_latest_anomalies",
    lambda e: queries.latest_anomalies(e, T0, T1),
    f"""{S} SELECT event_id, event_time, source_id, anomaly_score, processed_at FROM scored
    WHERE is_anomaly AND {RANGE} ORDER BY event_time DESC, event_id LIMIT 100""",
)
on_scored(
    "q20_active_model_version",
    lambda e: queries.active_model_version(e),
    f"{S} SELECT event_time AS time, model_version FROM scored ORDER BY event_time DESC, event_id DESC LIMIT 1",
)
on_scored(
    "q26_live_metrics",
    lambda e: queries.live_metrics(e),
    f"""{S} SELECT round(count(*) FILTER (WHERE event_time >= {NEWEST} - INTERVAL 10 SECOND) / 10.0::DOUBLE, 2)
      AS events_per_second,
    round(coalesce(100.0::DOUBLE * count(*) FILTER (WHERE is_anomaly) / nullif(count(*), 0), 0.0), 2)
      AS anomaly_rate_percent
    FROM scored WHERE event_time >= {NEWEST} - INTERVAL 5 MINUTE""",
)
on_scored(
    "q26_live_metrics_series",
    lambda e: queries.live_metrics_series(e),
    f"""{S}, c AS (SELECT ms // 5000 AS cell, is_anomaly FROM scored),
    t AS (SELECT cell + b AS tick, b, is_anomaly FROM c, range(1, 61) r(b))
    SELECT make_timestamp(tick * 5000000) AS tick,
      round(count(*) FILTER (WHERE b <= 2) / 10.0::DOUBLE, 2) AS events_per_second,
      round(100.0::DOUBLE * count(*) FILTER (WHERE is_anomaly) / count(*), 2) AS anomaly_rate_percent
    FROM t GROUP BY t.tick""",
)
on_scored(
    "q27_rate_rule",
    lambda e: queries.rate_rule(e),
    f"""{S}, ev AS (
      SELECT ms // 10000 + b AS tick,
        round(100.0::DOUBLE * count(*) FILTER (WHERE is_anomaly) / count(*), 2) AS anomaly_rate
      FROM scored, range(1, 13) r(b) GROUP BY 1),
    h AS (SELECT tick, anomaly_rate, count(*) FILTER (WHERE anomaly_rate > 5.0)
            OVER (ORDER BY tick RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS breaches FROM ev)
    SELECT make_timestamp(tick * 10000000) AS eval_time, anomaly_rate,
      CASE WHEN anomaly_rate <= 5.0 THEN 'Normal' WHEN breaches = 13 THEN 'Firing' ELSE 'Pending' END AS state
    FROM h""",
)
on_scored(
    "q28_seed_check",
    lambda e: queries.seed_check(e),
    f"""{S} SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomalies,
    count(DISTINCT source_id) AS sources FROM scored""",
)
on_scored(
    "q29_source_summary",
    lambda e: queries.source_summary(e),
    f"""{S} SELECT source_id, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomalies,
    round(avg(anomaly_score), 4) AS avg_score, min(event_time)::DATE AS oldest, max(event_time)::DATE AS newest
    FROM scored GROUP BY 1""",
)
