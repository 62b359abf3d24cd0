"""Registered streaming jobs: each works off the tables as a stream and returns its sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registered.alerts import PLAIN_ALERTS_SQL
from registered.common import SCORED_SQL as S
from registered.common import scored
from registered.events import HOURLY
from registered.events import ORACLES as EVENT_SQL
from registered.ingest import K_TEXT, UUID5, messages, with_severity
from registered.models import ORACLES as MODEL_SQL
from registered.models import GIVEN_TREES, PH, tree_sql, two_trees
from tidewarden.functions.quantiles import edges
from tidewarden.operators import features, half_space, notify
from tidewarden.plans import hourly, monitoring, retrain
from tidewarden.session import shared_dir
from tidewarden.sources import readers, sinks
from tidewarden.sources.registry import Registry
from tidewarden.streaming import alerting, batching, keyed, mergeable, progress, scoring, windows

QUERIES = {}
ORACLES = {}


def register(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def fit_model(s, sf, store):
    retrain.retrain(store, scored(s, sf), names=["k", "value"], skewed=["value"], trees=200, contamination=0.05, at_least=100)


def store_given(s, sf, store):
    """The written-down forest with a written-down scaler, as the active version."""
    store.save("forest", "given", two_trees().to_df(s))
    store.save("scaler", "given", features.Scaler("given", ["k", "value"], [-10.0, -10.0], [1.0, 2.0]).to_df(s))
    store.activate("given", dt.datetime(2024, 1, 1, tzinfo=dt.UTC))


def score_messages(s, sf, model=None):
    """Raw text messages through the scoring job, in several micro-batches."""
    base = shared_dir(s, "stream")
    store = Registry(s, f"{base}/registry")
    if model:
        model(s, sf, store)
    # Files, like a topic, hold no null values.
    messages(s, sf).filter("value is not null").repartition(8).write.text(f"{base}/raw")
    to = scoring.Targets(f"{base}/table", f"{base}/topic", f"{base}/dead", f"{base}/checkpoint")
    stream = readers.raw_stream(s, f"{base}/raw", max_per_trigger=4)
    scoring.start_scoring(stream, store, to, ["k", "value"]).awaitTermination()
    return to


register(
    "s01_scoring_stream",
    lambda s, sf: s.read.parquet(score_messages(s, sf).table).select(
        "event_id", "source_id", "event_type", "event_time", F.get("feature_vector", 0).alias("k"),
        F.get("feature_vector", 1).alias("value"), "is_anomaly", "severity", "model_version",
        F.col("anomaly_score").between(0.05, 0.35).alias("in_range"),
    ),
    f"""{S} SELECT {UUID5.format('event_id')} AS event_id, source_id,
      CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS event_type,
      CASE WHEN event_type = 'click' THEN event_time ELSE make_timestamp(ms * 1000) END AS event_time,
      {K_TEXT} AS k, value, false AS is_anomaly, 'LOW' AS severity, 'dummy-v0' AS model_version, true AS in_range
    FROM scored WHERE value < 230""",
)
SCORES = ("event_id", "source_id", "model_version", "anomaly_score", "is_anomaly", "severity")
register("s01_model_stream", lambda s, sf: s.read.parquet(score_messages(s, sf, fit_model).table).select(*SCORES))
register(
    "s01_given_model_stream",
    lambda s, sf: s.read.parquet(score_messages(s, sf, store_given).table).select(*SCORES).withColumn(
        "anomaly_score", F.round("anomaly_score", 9)
    ),
    f"""{S}, m AS (SELECT *, CASE WHEN event_type = 'click' THEN 0.0 ELSE coalesce({K_TEXT} + 10, 0) END::DOUBLE AS zk,
        CASE WHEN event_type = 'click' THEN 0.0 ELSE (value + 10) / 2 END::DOUBLE AS zv FROM scored WHERE value < 230),
    {tree_sql('m', 'zk', 'zv')}, r AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE - decision)) AS score FROM d)
    SELECT {UUID5.format('event_id')} AS event_id, source_id, 'given' AS model_version, round(score, 9) AS anomaly_score,
      decision < 0 OR score >= 0.7 AS is_anomaly, CASE WHEN NOT (decision < 0 OR score >= 0.7) OR score < 0.5 THEN 'LOW'
        WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM r""",
)
register(
    "s08_dead_letter_stream",
    lambda s, sf: s.read.parquet(score_messages(s, sf).dead_letters).select(
        "error_type", "error_message", "raw_payload"
    ),
    f"""{S} SELECT 'ValueError' AS error_type, CASE WHEN value >= 300 OR value < 240
      THEN 'Cannot deserialise message as Avro or JSON' ELSE 'Expected JSON object' END AS error_message,
      CASE WHEN value >= 300 THEN '{{{{broken message ' || event_id || '}}}}}}'
        WHEN value >= 250 THEN '[1,' || event_id || ']' WHEN value >= 240 THEN event_id ELSE '' END AS raw_payload
    FROM scored WHERE value >= 235""",
)


def reported(s, run):
    """What a run told a listener, after its end."""
    log = progress.ProgressLog(s, shared_dir(s, "progress"))
    s.streams.addListener(log)
    try:
        query = run()
        if not log.wait_for(query.runId):
            raise TimeoutError("the end of the query was not reported")
    finally:
        s.streams.removeListener(log)
    return progress.progress_rows(s, log.path)


def stream_counts(s, sf):
    """Outcomes as the scoring job counted them while it ran."""
    base = shared_dir(s, "counted")
    messages(s, sf).filter("value is not null").repartition(8).write.text(f"{base}/raw")
    to = scoring.Targets(f"{base}/table", f"{base}/topic", f"{base}/dead", f"{base}/checkpoint")

    def run():
        stream = readers.raw_stream(s, f"{base}/raw", max_per_trigger=4)
        query = scoring.start_scoring(stream, Registry(s, f"{base}/registry"), to, ["k", "value"])
        query.awaitTermination()
        return query

    return monitoring.progress_counts(reported(s, run))


register(
    "q30_stream_counts",
    stream_counts,
    """SELECT 'success' AS status, count(*) FILTER (WHERE value < 230) AS events FROM events
    UNION ALL SELECT 'error', count(*) FILTER (WHERE value >= 235) FROM events""",
)


def stream_lag(s, sf):
    """A feed that has read the events up to 25 January, while the others have come in."""
    base, e = shared_dir(s, "lagging"), scored(s, sf)
    early = F.col("event_time") < F.lit(dt.datetime(2024, 1, 25, tzinfo=dt.UTC))
    rows = e.select("event_id", "event_time")
    rows.filter(early).repartition(6).write.parquet(f"{base}/events")

    def run():
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/events")
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{base}/checkpoint")
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    report = reported(s, run)
    rows.filter(~early).write.mode("append").parquet(f"{base}/events")
    held = s.read.parquet(f"{base}/events").agg(F.count("*").alias("rows")).withColumn("path", F.lit(f"{base}/events"))
    return monitoring.topic_lag(monitoring.progress_offsets(report, held)).select(F.lit("events").alias("topic"), "lag")


register(
    "q33_stream_lag",
    stream_lag,
    "SELECT 'events' AS topic, count(*) AS lag FROM events WHERE ts >= TIMESTAMP '2024-01-25'",
)
FILES = 16  # written per part, so that a part is written and read by as many tasks


def event_files(s, sf, parts=4):
    """The scored view as files that follow one another in time, ``FILES`` for each part."""
    path = shared_dir(s, "events")
    e = with_severity(scored(s, sf)).withColumn("metadata", F.create_map().cast("map<string,string>"))
    second = F.unix_seconds("event_time")
    inner = edges(e.select(second.alias("_s")), "_s", parts)
    # One write after the other: a file stream goes by modification time.
    for part in range(parts):
        # Compared before anything is built for a row: three quarters of the rows are not of the part.
        of_part = F.lit(part <= len(inner))
        if part and part <= len(inner):
            of_part = of_part & (second >= inner[part - 1])
        if part < len(inner):
            of_part = of_part & (second < inner[part])
        elif inner:
            of_part = of_part & second.isNotNull()
        e.filter(of_part).repartition(FILES).write.mode("append").parquet(path)
    return path, e


def alert_stream(s, sf):
    """Scored events as a topic -> alerts table."""
    base = shared_dir(s, "alerting")
    topic, e = event_files(s, sf)
    sinks.insert_new(e, f"{base}/scored")
    a = alerting.Alerter(
        f"{base}/scored", f"{base}/alerts", f"{base}/topic", f"{base}/notes", f"{base}/checkpoint"
    )
    alerting.start_alerting(readers.scored_stream(s, topic, 2 * FILES), a).awaitTermination()
    return a


register(
    "s09_alerting_stream",
    lambda s, sf: s.read.parquet(alert_stream(s, sf).alert_table).drop("event_time", "created_date"),
    f"{PLAIN_ALERTS_SQL} SELECT *, 'ACTIVE' AS status FROM alerts",
)
register(
    "s09_alert_topic",
    lambda s, sf: sinks.read_batches(
        s, alert_stream(s, sf).alert_topic, "key string, value string, batch_id int"
    ).select(
        "key", F.get_json_object("value", "$.severity").alias("severity"),
        F.get_json_object("value", "$.created_at").cast("bigint").alias("created_at"),
    ),
    f"{PLAIN_ALERTS_SQL} SELECT alert_id AS key, severity, epoch_us(created_at) // 1000 AS created_at FROM alerts",
)


def to_files(stream, s, name):
    """Run an append stream to its end and return what it wrote."""
    base = shared_dir(s, name)
    scoring.state_store(s)
    q = (
        stream.writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{base}/out")


def doubled_files(s, sf):
    """Every event twice within a part, as producers that retry would send them."""
    path, _ = event_files(s, sf)
    again = shared_dir(s, "doubled")
    rows = s.read.parquet(path)
    rows.unionByName(rows).repartition(8).write.parquet(again)
    return again


register(
    "s06_unique_stream",
    lambda s, sf: to_files(
        windows.unique_stream(readers.scored_stream(s, doubled_files(s, sf), 8)), s, "unique"
    ).select("event_id", "event_time", "anomaly_score"),
    f"{S} SELECT event_id, event_time, anomaly_score FROM scored",
)
register(
    "s13_live_feed_stream",
    lambda s, sf: to_files(notify.live_feed(readers.scored_stream(s, event_files(s, sf)[0], 2 * FILES)), s, "feed"),
    f'{S} SELECT event_id, anomaly_score AS score, is_anomaly, source_id, event_time AS "timestamp" FROM scored',
)


def hourly_table(s, sf):
    path = shared_dir(s, "hourly-stream")
    scoring.state_store(s)
    stream = readers.scored_stream(s, event_files(s, sf, 2)[0], FILES)
    windows.start_hourly(stream, path, shared_dir(s, "hourly-checkpoint")).awaitTermination()
    return hourly.finish(hourly.read_partials(s, path)).withColumn("avg_score", F.round("avg_score", 9))


register("q07_hourly_stream", hourly_table, HOURLY)
# By watermark: what it has not passed at the end of the run does not come out.
PASSED = "<= (SELECT max(event_time) FROM scored) - INTERVAL {}"
register(
    "q13_ingestion_stream",
    lambda s, sf: to_files(windows.ingestion_stream(readers.scored_stream(s, event_files(s, sf)[0], FILES)), s, "rate"),
    f"""{S} SELECT time_bucket(INTERVAL '10 seconds', event_time) AS time, count(*) / 10.0::DOUBLE AS events_per_sec,
      round(100.0::DOUBLE * count(*) FILTER (WHERE is_anomaly) / count(*), 2) AS anomaly_rate_pct
    FROM scored GROUP BY 1 HAVING time + INTERVAL 10 SECOND {PASSED.format('3 HOUR')}""",
)
register(
    "q26_live_metrics_stream",
    lambda s, sf: to_files(windows.live_metrics_stream(readers.scored_stream(s, event_files(s, sf)[0], FILES)), s, "live"),
    f"SELECT * FROM ({EVENT_SQL['q26_live_metrics_series']}) WHERE tick <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
CLOCK_S = 60


def by_clock(s, sf, start, schema):
    """Every minute from the first event to the last, as a stream of times over the finished table."""
    base, e = shared_dir(s, "by-clock"), scored(s, sf)
    low, high = e.agg(F.min(F.unix_seconds("event_time")), F.max(F.unix_seconds("event_time"))).first()
    ticks = s.range(low - low % CLOCK_S, high + 1, CLOCK_S, 8).select(F.timestamp_seconds("id").alias("at"))
    ticks.write.parquet(f"{base}/clock")
    clock = s.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/clock")
    start(clock, lambda: e, f"{base}/out", f"{base}/checkpoint", CLOCK_S).awaitTermination()
    return sinks.read_batches(s, f"{base}/out", schema).drop("batch_id")


MINUTES = f"""SELECT make_timestamp(s * 1000000) AS tick FROM (SELECT unnest(range(min(ms) // 1000 // {CLOCK_S} * {CLOCK_S},
    max(ms) // 1000 + 1, {CLOCK_S})) AS s FROM (SELECT epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ms FROM events))"""
register(
    "q27_rate_rule_by_clock",
    lambda s, sf: by_clock(s, sf, windows.start_rate_rule, "eval_time timestamp, anomaly_rate double, state string, batch_id int"),
    f"""SELECT m.tick AS eval_time, anomaly_rate, coalesce(state, 'NoData') AS state
    FROM ({MINUTES}) m LEFT JOIN ({EVENT_SQL['q27_rate_rule']}) r ON r.eval_time = m.tick""",
)
register(
    "q26_live_metrics_by_clock",
    lambda s, sf: by_clock(
        s, sf, windows.start_live_metrics, "tick timestamp, events_per_second double, anomaly_rate_percent double, batch_id int"
    ),
    f"""SELECT tick, coalesce(events_per_second, 0) AS events_per_second, coalesce(anomaly_rate_percent, 0) AS anomaly_rate_percent
    FROM ({MINUTES}) m LEFT JOIN ({EVENT_SQL['q26_live_metrics_series']}) r USING (tick)""",
)
HIGH_WINDOW = 6 * 3_600_000
register(
    "a04_burst_state_stream",
    lambda s, sf: to_files(
        keyed.burst_stream(readers.scored_stream(s, event_files(s, sf)[0], FILES), 0.3, HIGH_WINDOW), s, "bursts"
    ),
    f"""{S} SELECT source_id, event_id, count(*) FILTER (WHERE anomaly_score >= 0.3::DOUBLE) OVER (
      PARTITION BY source_id ORDER BY ms RANGE BETWEEN {HIGH_WINDOW - 1} PRECEDING AND CURRENT ROW) AS burst_count
    FROM scored""",
)
BURSTS_SQL = ORACLES["a04_burst_state_stream"]
register(
    "a04_burst_expiry_stream",
    lambda s, sf: to_files(
        keyed.burst_stream(readers.scored_stream(s, event_files(s, sf)[0], FILES), 0.3, HIGH_WINDOW, expire=True), s, "bursts"
    ),
    BURSTS_SQL,
)
# Batches of 7 rows or 6 hours in 8 lanes; what the watermark has not passed at the end is still held.
LANE = "(n % 8)::INTEGER"
register(
    "s07_write_batches",
    lambda s, sf: to_files(
        batching.write_batches(
            readers.scored_stream(s, event_files(s, sf)[0], FILES), F.to_json(F.struct("source_id", "anomaly_score")),
            lane=F.pmod(F.col("event_id").cast("bigint"), F.lit(8)), size=7, wait_ms=HIGH_WINDOW, by_clock=False,
        ), s, "write-batches",
    ).groupBy("lane", "batch").agg(
        F.max("size").alias("size"), F.count("*").alias("rows"), F.min(F.col("event_id").cast("bigint")).alias("first_id"),
        F.max(F.col("event_id").cast("bigint")).alias("last_id"),
    ),
    f"""{S.replace('WITH scored', 'WITH RECURSIVE scored')}, x AS (SELECT {LANE} AS lane, n, ms,
        row_number() OVER (PARTITION BY n % 8 ORDER BY ms, event_id) AS i FROM scored),
    w AS (SELECT lane, i, n, ms, 0::BIGINT AS batch, 1 AS k, ms AS since FROM x WHERE i = 1 UNION ALL
      SELECT x.lane, x.i, x.n, x.ms, CASE WHEN w.k = 7 OR x.ms >= since + {HIGH_WINDOW} THEN batch + 1 ELSE batch END,
        CASE WHEN w.k = 7 OR x.ms >= since + {HIGH_WINDOW} THEN 1 ELSE k + 1 END,
        CASE WHEN w.k = 7 OR x.ms >= since + {HIGH_WINDOW} THEN x.ms ELSE since END
      FROM w JOIN x ON x.lane = w.lane AND x.i = w.i + 1),
    b AS (SELECT lane, batch, count(*)::INTEGER AS size, count(*) AS rows, min(n) AS first_id, max(n) AS last_id, max(since) AS since,
        max(batch) OVER (PARTITION BY lane) AS newest FROM w GROUP BY lane, batch)
    SELECT lane, batch, size, rows, first_id, last_id FROM b
    WHERE size = 7 OR batch < newest OR since + {HIGH_WINDOW} <= (SELECT max(ms) - 10000 FROM scored)""",
)
register(
    "m14_half_space_stream",
    lambda s, sf: to_files(
        keyed.half_space_stream(
            readers.scored_stream(s, event_files(s, sf)[0], FILES), "event_type", "feature_vector", 2
        ), s, "half-space",
    ).withColumnRenamed("key", "event_type"),
)
register(
    "m14_given_trees_stream",
    lambda s, sf: to_files(
        keyed.half_space_stream(
            readers.scored_stream(s, event_files(s, sf)[0], FILES), "event_type", "feature_vector", 2,
            half_space.Params(trees=2, height=2), GIVEN_TREES,
        ), s, "half-space",
    ).withColumnRenamed("key", "event_type").withColumn("score", F.round("score", 9)),
    MODEL_SQL["m14_given_trees"],
)


def merged(s, sf, start, schema):
    """What a stream with mergeable state wrote, batch by batch."""
    base = shared_dir(s, "merged")
    events = readers.scored_stream(s, event_files(s, sf)[0], FILES)
    start(events, f"{base}/out", f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return sinks.read_batches(s, f"{base}/out", schema).drop("batch_id")


register(
    "a04_burst_merged_stream",
    lambda s, sf: merged(
        s, sf, lambda e, *to: mergeable.start_bursts(e, *to, high=0.3, window_ms=HIGH_WINDOW, storm=20),
        "source_id string, event_id string, burst_count bigint",
    ),
    BURSTS_SQL,
)
register(
    "m14_merged_trees_stream",
    lambda s, sf: merged(
        s, sf,
        lambda e, *to: mergeable.start_half_space(
            e, *to, "event_type", "feature_vector", 2, half_space.Params(trees=2, height=2), GIVEN_TREES
        ),
        "key string, event_id string, position bigint, score double",
    ).withColumnRenamed("key", "event_type").withColumn("score", F.round("score", 9)),
    MODEL_SQL["m14_given_trees"],
)
register(
    "m15_page_hinkley_stream",
    lambda s, sf: to_files(
        keyed.drift_stream(readers.scored_stream(s, event_files(s, sf)[0], FILES), "model_version", "anomaly_score", PH),
        s, "drift",
    ).select(F.col("key").alias("model_version"), "event_id"),
    f"SELECT model_version, event_id FROM ({MODEL_SQL['m15_page_hinkley']})",
)
