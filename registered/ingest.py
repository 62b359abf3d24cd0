"""Registered source, decode, validation and feature queries with their SQL twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registered.common import SCORED_SQL as S
from registered.common import scored, table
from tidewarden.functions import avro, identity
from tidewarden.functions.timebuckets import latest_time, literal_ts
from tidewarden.operators import decode, features, notify
from tidewarden.plans import hourly, maintenance
from tidewarden.schema import RAW_EVENT_AVRO
from tidewarden.session import shared_dir
from tidewarden.sources import readers, registry, sinks, synthetic

QUERIES = {}
ORACLES = {}


def register(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def rounded(df, *names, digits=9):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


# --- messages --------------------------------------------------------------------


def spread_out(e):
    """The rows over all cores, whatever the files and row groups they lie in."""
    return e.repartition(4 * e.sparkSession.sparkContext.defaultParallelism)


def messages(s, sf):
    """The events as they would arrive: two envelopes, and some that cannot be read."""
    e = table(s, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k")
    as_list = F.concat(
        F.lit('{"event_id":"'), F.col("event_id"), F.lit('","source_id":"'), F.col("user_id"),
        F.lit('","feature_vector":['), k, F.lit(","), F.col("value"),
        F.lit('],"timestamp":"'), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit('Z","metadata":{"kind":"'), F.col("event_type"), F.lit('"}}'),
    )
    as_map = F.concat(
        F.lit('{"event_id":"'), F.col("event_id"), F.lit('","source_id":"'), F.col("user_id"),
        F.lit('","event_type":"'), F.col("event_type"), F.lit('","features":{"k":'),
        F.when(k.cast("int") < 5, F.lit("null")).when(k.cast("int") < 10, F.lit("NaN"))
        .when(k.cast("int") < 15, F.lit('"Infinity"')).when(k.cast("int") < 20, F.lit('"not_a_float"'))
        .when(k.cast("int") < 25, F.lit("true")).when(k.cast("int") < 30, F.concat(F.lit('" '), k, F.lit('e0"')))
        .otherwise(k),
        F.lit(',"value":'), F.col("value"), F.lit('},"event_time":'), F.unix_millis("t"), F.lit("}"),
    )
    broken = F.concat(F.lit("{{broken message "), F.col("event_id"), F.lit("}}}"))
    value = (
        F.when(F.col("value") >= 300, broken)
        .when(F.col("value") >= 250, F.concat(F.lit("[1,"), F.col("event_id"), F.lit("]")))
        .when(F.col("value") >= 240, F.col("event_id").cast("string"))
        .when(F.col("value") >= 235, F.lit(""))
        .when(F.col("value") >= 230, F.lit(None))
        .when(F.col("event_type") == "click", as_list)
        .otherwise(as_map)
    )
    # A generator keeps the text from being rebuilt by every use of the column.
    return spread_out(e).select(F.explode(F.array(value)).alias("value"))


K_TEXT = """CASE WHEN event_type = 'click' THEN k WHEN k < 20 THEN NULL WHEN k < 25 THEN 1.0 ELSE k END"""
register(
    "n01_n02_decode_and_normalise",
    lambda s, sf: decode.normalise(decode.decode(messages(s, sf)), ["k", "value"]).select(
        "event_id", "source_id", "event_type", "event_time",
        F.coalesce(F.try_element_at("features", F.lit("k")), F.try_element_at("features", F.lit("f0"))).alias("k"),
        F.get("feature_vector", 1).alias("value"),
        F.size("feature_vector").alias("width"),
        F.try_element_at("metadata", F.lit("kind")).alias("kind"),
    ),
    f"""{S} SELECT event_id, source_id, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS event_type,
      CASE WHEN event_type = 'click' THEN event_time ELSE make_timestamp(ms * 1000) END AS event_time,
      {K_TEXT} AS k, value, 2 AS width, CASE WHEN event_type = 'click' THEN 'click' END AS kind
    FROM scored WHERE value < 230""",
)


def avro_messages(s, sf):
    """The events as framed Avro; some cut short, some as JSON text, some as neither."""
    e = table(s, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("double")
    text = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("sourcé-"), F.col("user_id")).alias("source_id"),
            "event_type", F.create_map(F.lit("k"), k, F.lit("value"), F.col("value")).alias("features"),
            F.unix_millis("t").alias("event_time"),
        )
    )
    framed = avro.to_framed(F.col("text"), RAW_EVENT_AVRO)
    e = spread_out(e).select("value", F.explode(F.array(text)).alias("text"))
    # Through a generator each message is framed once, not again for every use of it.
    e = e.select("value", "text", F.explode(F.array(framed)).alias("framed"))
    whole, cut = F.col("framed"), F.expr("substring(framed, 1, length(framed) - 3)")
    message = F.when(F.col("value") >= 300, cut).when(F.col("value") >= 250, F.concat(F.lit(b"\x00"), F.col("text").cast("binary")))
    message = message.when(F.col("value") >= 200, F.col("text").cast("binary")).otherwise(whole)
    return e.select(F.explode(F.array(message)).alias("value"))


def avro_decoded(s, sf):
    """Good rows with their values, refused ones with the reason only."""
    d = decode.decode(avro_messages(s, sf), avro_schema=RAW_EVENT_AVRO)
    # Both in one pass: a union would frame and decode every message twice.
    return decode.normalise(d, ["k", "value"], refused=True).select(
        "event_id", "source_id", "event_type", "event_time", F.get("feature_vector", 0).alias("k"),
        F.get("feature_vector", 1).alias("value"), "bad",
    )


register(
    "n01_avro_decode",
    avro_decoded,
    f"""{S} SELECT event_id, 'sourcé-' || source_id AS source_id, event_type, make_timestamp(ms * 1000) AS event_time, k, value,
      NULL::VARCHAR AS bad FROM scored WHERE value < 250
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'Cannot deserialise message as Avro or JSON' FROM scored WHERE value >= 250""",
)
register(
    "s08_dead_letters",
    lambda s, sf: decode.dead_letters(decode.decode(messages(s, sf))).drop("failed_at_ms"),
    f"""{S} SELECT 0 AS task_id, 'ValueError' AS error_type,
      CASE WHEN value >= 300 OR value < 240 THEN 'Cannot deserialise message as Avro or JSON' ELSE 'Expected JSON object' END
        AS error_message,
      CASE WHEN value >= 300 THEN '{{{{broken message ' || event_id || '}}}}}}'
        WHEN value >= 250 THEN '[1,' || event_id || ']' WHEN value >= 240 THEN event_id ELSE '' END AS raw_payload
    FROM scored WHERE value >= 235""",
)
UUID5 = """(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
  substr('89ab', (('0x' || h[17:17])::INTEGER % 4) + 1, 1) || h[18:20] || '-' || h[21:32]
  FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({0})) AS h))"""


def uuid_inputs(s, sf):
    d = table(s, sf, "documents")
    digest = F.md5("text")
    dashed = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    raw = (
        F.when(F.col("lang") == "en", F.upper(dashed))
        .when(F.col("lang") == "fr", digest)
        .when(F.col("lang") == "de", F.concat(F.lit("{"), dashed, F.lit("}")))
        .otherwise(F.col("text"))
    )
    return d.select("doc_id", identity.safe_uuid(raw).alias("uuid"))


register(
    "n03_safe_uuid",
    uuid_inputs,
    f"""WITH d AS (SELECT doc_id, lang, md5(text) AS m, text FROM documents)
    SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de')
      THEN m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32]
      ELSE {UUID5.format('text')} END AS uuid FROM d""",
)
NOW = dt.datetime(2024, 2, 1, tzinfo=dt.UTC)
register(
    "n04_epoch_ms",
    lambda s, sf: table(s, sf, "events").select(
        "event_id",
        decode.epoch_ms_to_time(
            F.when(F.col("event_type") != "error", F.unix_millis(F.col("ts").cast("timestamp"))), literal_ts(NOW)
        ).alias("event_time"),
    ),
    f"""{S} SELECT n AS event_id, CASE WHEN event_type <> 'error' THEN make_timestamp(ms * 1000)
    ELSE TIMESTAMP '2024-02-01' END AS event_time FROM scored""",
)


def stored_vectors(s, sf):
    e = table(s, sf, "events")
    k = F.get_json_object("props", "$.k")
    text = F.when(
        F.col("event_type") == "view", F.concat(F.lit("["), k, F.lit(","), F.col("value"), F.lit("]"))
    ).otherwise(F.concat(F.lit('{"value":'), F.col("value"), F.lit(',"k":'), k, F.lit("}")))
    v = decode.read_vector(text, ["k", "value"])
    return e.select("event_id", F.get(v, 0).alias("k"), F.get(v, 1).alias("value"))


register("n05_read_vector", stored_vectors, f"{S} SELECT n AS event_id, k, value FROM scored")
register(
    "n06_defaults",
    lambda s, sf: decode.fill_defaults(
        scored(s, sf).select(
            "event_id",
            F.when(F.col("event_type") != "view", F.col("source_id")).alias("source_id"),
            F.when(F.col("event_type") != "click", F.col("anomaly_score")).alias("anomaly_score"),
            F.when(F.col("event_type") != "click", F.col("is_anomaly")).alias("is_anomaly"),
            F.when(F.col("event_type") != "error", F.col("model_version")).alias("model_version"),
        )
    ),
    f"""{S} SELECT event_id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE source_id END AS source_id,
      CASE WHEN event_type = 'click' THEN 0.0 ELSE anomaly_score END AS anomaly_score,
      event_type <> 'click' AND is_anomaly AS is_anomaly,
      CASE WHEN event_type = 'error' THEN 'unknown' ELSE model_version END AS model_version FROM scored""",
)
register(
    "n07_binarise_label",
    lambda s, sf: table(s, sf, "events").select(
        "event_id",
        decode.binarise_label(
            F.when(F.col("event_type") == "view", " benign ").when(F.col("event_type") == "click", "BENIGN")
            .when(F.col("event_type") != "error", F.col("event_type"))
        ).alias("label"),
    ),
    "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS label FROM events",
)


def ingest_checks(s, sf):
    """Documents submitted as events: the text is the source, its numbers the vector."""
    d = table(s, sf, "documents")
    n = F.col("n_chars").cast("double")
    vector = (
        F.when(F.col("n_chars") % 7 == 0, F.array(n, F.lit(float("nan"))))
        .when(F.col("n_chars") % 7 == 1, F.array(F.lit(float("-inf")), n))
        .when(F.col("n_chars") % 7 == 2, F.array().cast("array<double>"))
        .when(F.col("n_chars") % 7 == 3, F.array_repeat(n, 1025))
        .otherwise(F.array_repeat(n, 1024))
    )
    return d.select("doc_id", decode.ingest_problem(F.col("text"), vector).alias("problem"))


register(
    "v01_ingest_validation",
    ingest_checks,
    """SELECT doc_id, CASE WHEN length(text) NOT BETWEEN 1 AND 128 THEN 'source_id must have 1 to 128 characters'
      WHEN n_chars % 7 IN (2, 3) THEN 'feature_vector must have 1 to 1024 values'
      WHEN n_chars % 7 IN (0, 1) THEN 'feature_vector must not contain NaN or Inf values' END AS problem
    FROM documents""",
)
register(
    "v01_batch_size",
    lambda s, sf: table(s, sf, "events").groupBy("event_type").agg(F.count("*").alias("events")).select(
        "event_type", decode.batch_problem(F.col("events")).alias("problem")
    ),
    """SELECT event_type, CASE WHEN count(*) > 1000 THEN 'a batch must hold 1 to 1000 events' END AS problem
    FROM events GROUP BY 1""",
)
register(
    "v02_scored_validation",
    lambda s, sf: decode.split_scored(
        table(s, sf, "events").select(
            "event_id",
            (F.col("value") / 300.0 - 0.01).alias("anomaly_score"),
            F.upper("event_type").alias("kind"),
            F.when(F.col("event_type") == "view", "HIGH").when(F.col("event_type") == "click", "low")
            .otherwise("NONE").alias("severity"),
        )
    )[1],
    """SELECT event_id, value / 300.0::DOUBLE - 0.01::DOUBLE AS anomaly_score, upper(event_type) AS kind,
      CASE event_type WHEN 'view' THEN 'HIGH' WHEN 'click' THEN 'low' ELSE 'NONE' END AS severity FROM events
    WHERE event_type = 'click' OR value / 300.0::DOUBLE - 0.01::DOUBLE NOT BETWEEN 0 AND 1""",
)
register(
    "v03_label_domain",
    lambda s, sf: table(s, sf, "labels").select(
        "doc_id",
        decode.label_allowed(
            F.concat(F.when(F.col("toxic") == 1, "T").otherwise("F"), F.when(F.col("quality") == 1, "P").otherwise("x"))
        ).alias("allowed"),
    ),
    "SELECT doc_id, quality = 1 AS allowed FROM labels",
)

# --- sources and sinks -------------------------------------------------------------


def with_severity(e):
    from tidewarden.functions.severity import alert_severity

    return e.withColumn("severity", alert_severity(F.col("anomaly_score")))


def csv_scan(s, sf):
    folder = shared_dir(s, "csv")
    table(s, sf, "lineitem").select(
        F.col("l_extendedprice").alias("packet_length"),
        F.col("l_quantity").alias("flow_duration"),
        F.col("l_tax").alias("fwd_packets/s"),
        F.when(F.col("l_returnflag") == "N", "Benign").otherwise(F.col("l_returnflag")).alias(" Label"),
    ).write.option("header", "true").csv(folder)
    schema = "packet_length double, flow_duration double, `fwd_packets/s` double, ` Label` string"
    df = readers.training_csv(s, folder, schema)
    return df.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.sum("packet_length"), 2).alias("packet_length"),
        F.sum("flow_duration").alias("flow_duration"),
    )


register(
    "s02_training_csv",
    csv_scan,
    """SELECT CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS label, count(*) AS n,
    round(sum(l_extendedprice), 2) AS packet_length, sum(l_quantity) AS flow_duration FROM lineitem GROUP BY 1""",
)


def replay(s, sf):
    rows = table(s, sf, "lineitem")
    numbers = readers.replay_envelope(
        rows, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), F.col("l_shipdate").cast("timestamp")
    )
    f = F.col("features")
    return numbers.select(
        "event_id", "source_id", "event_type", "event_time",
        f["l_quantity"].alias("quantity"), f["l_discount"].alias("discount"), F.size(f).alias("features"),
    )


register(
    "s03_replay_envelope",
    replay,
    f"""SELECT {UUID5.format("l_orderkey || '-' || l_linenumber || '-' || l_partkey")} AS event_id,
      'cicids-replay' AS source_id, 'network_flow' AS event_type, epoch_us(l_shipdate) // 1000 AS event_time,
      l_quantity AS quantity, l_discount AS discount, 8 AS features FROM lineitem""",
)


def stored(s, sf, rounds=1, name="scored"):
    """The scored view written through the idempotent sink, ``rounds`` times over."""
    path = shared_dir(s, name)
    e = with_severity(scored(s, sf)).withColumn("metadata", F.create_map().cast("map<string,string>"))
    for _ in range(rounds):
        sinks.insert_new(e, path)
    return path


T0 = dt.datetime(2024, 1, 5, 6, tzinfo=dt.UTC)
T1 = dt.datetime(2024, 1, 20, 12, tzinfo=dt.UTC)
register(
    "s04_time_range_scan",
    lambda s, sf: readers.scored_table(s, stored(s, sf), T0, T1).select(
        "event_id", "event_time", "source_id", "anomaly_score"
    ),
    f"""{S} SELECT event_id, event_time, source_id, anomaly_score FROM scored
    WHERE event_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""",
)
register(
    "s05_scored_messages",
    lambda s, sf: sinks.as_messages(
        with_severity(scored(s, sf)).select("event_id", "source_id", "event_time", "is_anomaly", "severity", "features")
    ).select(
        "key",
        F.get_json_object("value", "$.source_id").alias("source_id"),
        F.get_json_object("value", "$.event_time").alias("event_time"),
        F.get_json_object("value", "$.is_anomaly").alias("is_anomaly"),
        F.get_json_object("value", "$.features.value").cast("double").alias("value"),
    ),
    f"""{S} SELECT event_id AS key, source_id, CAST(ms AS VARCHAR) AS event_time,
      CAST(is_anomaly AS VARCHAR) AS is_anomaly, value FROM scored""",
)
register(
    "s06_idempotent_insert",
    lambda s, sf: s.read.parquet(stored(s, sf, rounds=3)).groupBy("event_date").agg(
        F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.count_if("is_anomaly").alias("anomalies")
    ),
    f"""{S} SELECT event_date, count(*) AS n, count(DISTINCT event_id) AS ids,
    count(*) FILTER (WHERE is_anomaly) AS anomalies FROM scored GROUP BY 1""",
)


def control_log(s, sf):
    """Control messages: errors reload, signups roll back, clicks carry no version."""
    e = table(s, sf, "events")
    version = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss")
    value = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"action":"reload","version":"'), version, F.lit('"}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"command":"ROLLBACK","target_version":"'), version, F.lit('"}')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"model_version":"'), version, F.lit('"}')))
        .when(F.col("event_type") == "click", F.lit('{"action":"ping"}'))
        .otherwise(F.lit("not json"))
    )
    return e.select(value.alias("value"), F.col("ts").cast("timestamp").alias("event_time"))


register(
    "s10_newest_version",
    lambda s, sf: readers.newest_version(readers.control_messages(control_log(s, sf))),
    f"""{S} SELECT strftime(event_time, '%Y%m%d_%H%M%S') AS version, event_time AS since FROM scored
    WHERE event_type IN ('error', 'signup', 'view') ORDER BY event_time DESC LIMIT 1""",
)


def save_and_load(s, sf):
    r = registry.Registry(s, shared_dir(s, "registry"))
    e = scored(s, sf)
    for version in ("20240101_000000", "20240102_000000"):
        r.save("scaler", version, features.fit_scaler(e, ["k", "value"], ["value"], version).to_df(s))
    found = r.resolve("scaler")
    r.activate(found, NOW)
    r.rollback("20240101_000000", NOW + dt.timedelta(hours=1), "worse", "scaler")
    back = features.Scaler.from_df(r.load("scaler", r.active()), r.active())
    return rounded(back.to_df(s).withColumn("latest", F.lit(found)), "mean", "scale")


register(
    "s11_model_artifacts",
    save_and_load,
    f"""{S}, v AS (SELECT 0 AS position, 'k' AS name, k AS x FROM scored
      UNION ALL SELECT 1, 'value', ln(1 + greatest(value, 0)) FROM scored)
    SELECT '20240101_000000' AS version, position, name, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS scale,
      name = 'value' AS skewed, '20240102_000000' AS latest FROM v GROUP BY position, name""",
)
register(
    "s12_latest_version",
    lambda s, sf: registry.latest_version(scored(s, sf), "model_version"),
    f"{S} SELECT coalesce(max(model_version), 'default') AS version FROM scored",
)
register(
    "s13_live_feed",
    lambda s, sf: notify.live_feed(scored(s, sf)),
    f'{S} SELECT event_id, anomaly_score AS score, is_anomaly, source_id, event_time AS "timestamp" FROM scored',
)
register(
    "s14_critical_annotations",
    lambda s, sf: notify.critical_annotations(scored(s, sf)).withColumn("tags", F.array_join("tags", ",")),
    f"""{S} SELECT ms AS time, 'critical,anomaly,' || source_id AS tags,
      'CRITICAL Anomaly (Score: ' || anomaly_score || ')' AS text FROM scored WHERE anomaly_score >= 0.95::DOUBLE""",
)
register(
    "s14_critical_annotation_texts",
    lambda s, sf: notify.critical_annotations(scored(s, sf)).withColumn("tags", F.array_join("tags", ",")),
    f"""{S} SELECT ms AS time, 'critical,anomaly,' || source_id AS tags,
      'CRITICAL Anomaly (Score: ' || anomaly_score || ')' AS text FROM scored WHERE anomaly_score >= 0.95::DOUBLE""",
)
register(
    "s14_anomaly_annotations",
    lambda s, sf: notify.anomaly_annotations(scored(s, sf)).withColumn("tags", F.array_join("tags", ",")),
    f"""{S}, a AS (SELECT *, CASE WHEN anomaly_score >= 0.95::DOUBLE THEN 'critical'
        WHEN anomaly_score >= 0.85::DOUBLE THEN 'high' WHEN anomaly_score >= 0.75::DOUBLE THEN 'medium' ELSE 'low' END AS sv
      FROM scored WHERE is_anomaly)
    SELECT 'anomaly-overview' AS dashboard, ms AS time, 'anomaly,' || sv || ',source:' || source_id AS tags,
      'Anomaly detected | Score: ' || printf('%.4f', anomaly_score) || ' | Severity: ' || sv || ' | Source: ' || source_id
        || ' | Model: ' || model_version AS text FROM a""",
)


def publication(s, sf):
    path = shared_dir(s, "published")
    d = table(s, sf, "documents").select(
        F.col("text").alias("source_id"),
        F.when(F.col("n_chars") % 2 == 0, F.array(F.col("n_chars").cast("double")))
        .otherwise(F.array().cast("array<double>")).alias("feature_vector"),
    )
    refused = sinks.publish_events(d, path)
    return s.read.parquet(path).agg(F.count("*").alias("n")).withColumn("kind", F.lit("accepted")).unionByName(
        refused.agg(F.count("*").alias("n")).withColumn("kind", F.lit("refused"))
    )


register(
    "s15_publish_events",
    publication,
    """SELECT count(*) AS n, CASE WHEN n_chars % 2 = 0 AND length(text) BETWEEN 1 AND 128 THEN 'accepted'
      ELSE 'refused' END AS kind FROM documents GROUP BY 2""",
)


def long_ids(s, sf):
    """Documents published under their whole text; those over 128 characters are refused."""
    path = shared_dir(s, "published-long")
    d = table(s, sf, "documents").select(
        F.col("text").alias("source_id"), F.array(F.col("n_chars").cast("double")).alias("feature_vector")
    )
    refused = sinks.publish_events(d, path)
    columns = [F.length("source_id").alias("id_length"), F.col("feature_vector")[0].cast("long").alias("n_chars")]
    return s.read.parquet(path).select(*columns, F.lit(None).cast("string").alias("problem")).unionByName(
        refused.select(*columns, "problem")
    )


register(
    "s15_publish_long_ids",
    long_ids,
    """SELECT length(text)::INT AS id_length, n_chars::BIGINT AS n_chars, CASE WHEN text IS NULL OR length(text) NOT BETWEEN 1 AND 128
      THEN 'source_id must have 1 to 128 characters' WHEN n_chars IS NULL THEN 'feature_vector must not contain NaN or Inf values'
      END AS problem FROM documents""",
)
register(
    "s19_events_at_scores",
    lambda s, sf: synthetic.at_scores(
        scored(s, sf).select("source_id", F.col("anomaly_score").alias("score")), NOW
    ).select("source_id", "event_type", F.col("features")["f4"].alias("f4"), "is_anomaly", "severity", "event_time"),
    f"""{S} SELECT source_id, 'synthetic-test' AS event_type, anomaly_score AS f4, is_anomaly,
      CASE WHEN anomaly_score >= 0.95::DOUBLE THEN 'CRITICAL' WHEN anomaly_score >= 0.90::DOUBLE THEN 'HIGH'
        WHEN anomaly_score >= 0.80::DOUBLE THEN 'MEDIUM' WHEN anomaly_score >= 0.70::DOUBLE THEN 'LOW' ELSE 'NONE' END
        AS severity, TIMESTAMP '2024-02-01' AS event_time FROM scored""",
)

# --- features ------------------------------------------------------------------------

# Order lines stand in for network flows.
FLOW = ["packet_length", "flow_duration", "fwd_packets/s", "bwd_packets/s", "flag_counts"]


def flows(s, sf):
    """Flow features per order line; some are missing, NaN or infinite."""
    li = table(s, sf, "lineitem")
    duration = (
        F.when(F.col("l_returnflag") == "R", F.lit(float("inf")))
        .when(F.col("l_returnflag") == "A", F.lit(float("nan")))
        .otherwise(F.col("l_quantity") - 5.0)
    )
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        # A generator keeps the map from being built again for every feature taken from it.
        F.explode(F.array(F.create_map(
            F.lit("packet_length"), F.col("l_extendedprice"),
            F.lit("flow_duration"), duration,
            F.lit("fwd_packets/s"), F.when(F.col("l_linestatus") == "O", F.col("l_discount")),
            F.lit("bwd_packets/s"), F.col("l_tax"),
        ))).alias("features"),
    )


FLOWS_SQL = """WITH flows AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
    l_extendedprice AS p, CASE WHEN l_returnflag NOT IN ('R', 'A') THEN l_quantity - 5 END AS d,
    CASE WHEN l_linestatus = 'O' THEN l_discount END AS f, l_tax AS b FROM lineitem),
  logs AS (SELECT id, ln(1 + greatest(p, 0)) AS p, CASE WHEN d IS NOT NULL THEN ln(1 + greatest(d, 0)) END AS d, f, b FROM flows)"""


def spread(df, vector, names=("p", "d", "f", "b", "g"), digits=8):
    return df.select("id", *[F.round(F.get(vector, F.lit(i)), digits).alias(n) for i, n in enumerate(names)])


register(
    "f01_f02_align_raw_zero",
    lambda s, sf: spread(
        flows(s, sf).withColumn(
            "v", F.array(*[F.coalesce(features.prepared(F.col("features"), n, [], "raw_zero")) for n in FLOW])
        ),
        F.col("v"),
    ),
    f"""{FLOWS_SQL} SELECT id, round(p, 8) AS p, coalesce(d, 0.0) AS d, coalesce(f, 0.0) AS f, b, 0.0::DOUBLE AS g
    FROM flows""",
)
register(
    "f01_align",
    lambda s, sf: spread(
        table(s, sf, "events").select(
            F.col("event_id").alias("id"),
            features.align(F.create_map(F.lit("k"), F.get_json_object("props", "$.k")), ["absent", "k"]).alias("v"),
        ),
        F.col("v"), ("absent", "k"),
    ),
    f"{S} SELECT n AS id, 0.0::DOUBLE AS absent, k FROM scored",
)
register(
    "f03_log1p",
    lambda s, sf: flows(s, sf).select(
        "id", F.round(features.prepared(F.col("features"), "packet_length", FLOW), 9).alias("p"),
        F.round(features.prepared(F.col("features"), "flow_duration", FLOW), 9).alias("d"),
    ),
    f"{FLOWS_SQL} SELECT id, round(p, 9) AS p, round(d, 9) AS d FROM logs",
)


def scaler_rows(impute):
    def build(s, sf):
        return rounded(
            features.fit_scaler(flows(s, sf), version="v1", impute=impute).to_df(s), "mean", "scale", digits=8
        ).drop("version")

    return build


for _impute, _zero in (("mean", "{}"), ("raw_zero", "coalesce({}, 0.0)")):
    register(
        f"f04_fit_scaler_{_impute}",
        scaler_rows(_impute),
        f"""{FLOWS_SQL}, v AS (
          SELECT 0 AS position, 'packet_length' AS name, p AS x, true AS skewed FROM logs
          UNION ALL SELECT 1, 'flow_duration', {_zero.format('d')}, true FROM logs
          UNION ALL SELECT 2, 'fwd_packets/s', {_zero.format('f')}, false FROM logs
          UNION ALL SELECT 3, 'bwd_packets/s', b, false FROM logs
          UNION ALL SELECT 4, 'flag_counts', 0.0, false FROM logs)
        SELECT position, name, round(avg(x), 8) AS mean,
          CASE WHEN position = 4 THEN 1.0 ELSE round(stddev_pop(x), 8) END AS scale, skewed
        FROM v GROUP BY position, name, skewed""",
    )


def scaled(impute):
    def build(s, sf):
        f = flows(s, sf)
        scaler = features.fit_scaler(f, impute=impute)
        return spread(f.withColumn("v", features.scaled_vector(F.col("features"), scaler, impute)), F.col("v"), digits=6)

    return build


for _name, _impute, _d, _f in (
    ("f05_scale_raw_zero", "raw_zero", "coalesce(d, 0.0)", "coalesce(f, 0.0)"),
    ("f05_f06_scale_mean", "mean", "d", "f"),
):
    register(
        _name,
        scaled(_impute),
        f"""{FLOWS_SQL}, x AS (SELECT id, p, {_d} AS d, {_f} AS f, b FROM logs),
          m AS (SELECT avg(p) mp, stddev_pop(p) sp, avg(d) md, stddev_pop(d) sd, avg(f) mf, stddev_pop(f) sf,
            avg(b) mb, stddev_pop(b) sb FROM x)
        SELECT id, round((p - mp) / sp, 6) AS p, round(coalesce((d - md) / sd, 0.0), 6) AS d,
          round(coalesce((f - mf) / sf, 0.0), 6) AS f, round((b - mb) / sb, 6) AS b, 0.0::DOUBLE AS g FROM x, m""",
    )


def online(s, sf):
    """Raw messages of both kinds, coerced against a scaler in serving order."""
    n = decode.normalise(decode.decode(messages(s, sf)))
    names = ["k", "value", "absent"]
    scaler = features.Scaler("v", names, [50.0, 3.0, 7.0], [20.0, 1.5, 2.0], ["value"])
    return spread(
        n.withColumn("id", F.col("event_id")).withColumn("v", features.scaled_vector(F.col("features"), scaler)),
        F.col("v"), ("k", "value", "absent"), 9,
    )


register(
    "f06_online_coercion",
    online,
    f"""{S} SELECT event_id AS id,
      CASE WHEN event_type = 'click' THEN 0.0 ELSE round(coalesce(({K_TEXT} - 50) / 20, 0.0), 9) END AS k,
      CASE WHEN event_type = 'click' THEN 0.0 ELSE round((ln(1 + value) - 3) / 1.5, 9) END AS value, 0.0::DOUBLE AS absent
    FROM scored WHERE value < 230""",
)


def fallback(s, sf):
    scaler = features.fallback_scaler()
    v = F.col("v")
    scaled = F.explode(F.array(features.scaled_vector(F.col("features"), scaler))).alias("v")
    return flows(s, sf).select("id", scaled).select(
        "id", F.size(v).alias("width"), F.round(F.get(v, F.lit(0)), 9).alias("p"), F.get(v, F.lit(3)).alias("b"),
        F.get(v, F.lit(20)).alias("last"), F.lit(scaler.version).alias("version"),
        F.size(features.zero_vector()).alias("zeros"),
    )


register(
    "f07_fallback_scaler",
    fallback,
    f"""{FLOWS_SQL} SELECT id, 21 AS width, round(p, 9) AS p, b, 0.0::DOUBLE AS last, 'dummy-v0' AS version, 21 AS zeros
    FROM logs""",
)


def ae_normalised(s, sf):
    li = table(s, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.array("l_quantity", "l_extendedprice", "l_discount").alias("v"),
    )
    mean, std = features.vector_moments(li, "v", 3)
    return spread(li.withColumn("v", features.normalise_vector(F.col("v"), mean, std)), F.col("v"), ("q", "p", "d"), 6)


register(
    "f08_autoencoder_normalise",
    ae_normalised,
    """WITH m AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) + 1e-8 sq, avg(l_extendedprice) mp,
      stddev_pop(l_extendedprice) + 1e-8 sp, avg(l_discount) md, stddev_pop(l_discount) + 1e-8 sd FROM lineitem)
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
      round((l_quantity - mq) / sq, 6) AS q, round((l_extendedprice - mp) / sp, 6) AS p,
      round((l_discount - md) / sd, 6) AS d FROM lineitem, m""",
)
register(
    "f09_temporal",
    lambda s, sf: features.with_temporal(scored(s, sf)).select(
        "event_id", "hour_of_day", "day_of_week", "is_market_hours"
    ),
    f"""{S} SELECT event_id, CAST(hour(event_time) AS INTEGER) AS hour_of_day,
      CAST(isodow(event_time) - 1 AS INTEGER) AS day_of_week,
      isodow(event_time) <= 5 AND hour(event_time) * 60 + minute(event_time) BETWEEN 570 AND 959 AS is_market_hours
    FROM scored""",
)
ROLL_MS = 6 * 3_600_000
register(
    "f10_rolling",
    lambda s, sf: rounded(
        features.with_rolling(
            scored(s, sf).withColumn("value", F.col("feature_vector")[1]), "value", width_ms=ROLL_MS, chunk_ms=4 * ROLL_MS
        ).select("event_id", "rolling_mean_5m", "rolling_std_5m", "deviation_from_mean", "volume_z_score"),
        "rolling_mean_5m", "rolling_std_5m", "deviation_from_mean", "volume_z_score", digits=5,
    ),
    f"""{S}, r AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS c
      FROM scored WINDOW w AS (PARTITION BY source_id ORDER BY ms RANGE BETWEEN {ROLL_MS} PRECEDING AND CURRENT ROW))
    SELECT event_id, round(m, 5) AS rolling_mean_5m, round(CASE WHEN c = 1 THEN 0 ELSE sd END, 5) AS rolling_std_5m,
      round(value - m, 5) AS deviation_from_mean,
      round(CASE WHEN c = 1 OR sd = 0 THEN 0 ELSE (value - m) / sd END, 5) AS volume_z_score FROM r""",
)
register(
    "f11_return",
    lambda s, sf: rounded(
        features.with_return(
            scored(s, sf).withColumn("value", F.col("feature_vector")[1]), "value",
            lag_ms=ROLL_MS // 2, look_back_ms=2 * ROLL_MS, chunk_ms=4 * ROLL_MS,
        ).select("event_id", "price_return_1m"),
        "price_return_1m", digits=6,
    ),
    f"""{S} SELECT event_id, round(value / (SELECT max_by(p.value, (p.ms, p.event_id)) FROM scored p
        WHERE p.source_id = a.source_id AND p.ms <= a.ms - {ROLL_MS // 2} AND p.ms >= a.ms - {ROLL_MS // 2 + 2 * ROLL_MS})
      - 1, 6) AS price_return_1m FROM scored a""",
)

# --- hourly table and maintenance ------------------------------------------------------


def refreshed(s, sf):
    """Build the hourly table once, then let the refresh policy redo its hours."""
    e = scored(s, sf)
    path = shared_dir(s, "hourly")
    as_of = latest_time(e)
    hourly.refresh(e, path, as_of - dt.timedelta(hours=6), full=True)
    for back in range(5, -1, -1):
        hourly.refresh(e, path, as_of - dt.timedelta(hours=back))
    return path


HOURS = """SELECT time_bucket(INTERVAL '1 hour', event_time) AS bucket, source_id, count(*) AS event_count,
  round(avg(anomaly_score), 9) AS avg_score, max(anomaly_score) AS max_score FROM scored {} GROUP BY 1, 2"""
register(
    "q08_incremental_refresh",
    lambda s, sf: rounded(hourly.finish(hourly.read_partials(s, refreshed(s, sf))), "avg_score"),
    f"""{S} {HOURS.format("WHERE event_time < date_trunc('hour', (SELECT max(event_time) FROM scored) - INTERVAL 1 HOUR)")}""",
)
register(
    "q09_realtime_read",
    lambda s, sf: rounded(
        hourly.realtime(scored(s, sf), hourly.read_partials(s, refreshed(s, sf))), "avg_score"
    ),
    f"{S} {HOURS.format('')}",
)


def retained(s, sf):
    path = stored(s, sf)
    maintenance.drop_expired(s, path, latest_time(scored(s, sf)), dt.timedelta(days=12))
    return s.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("n"))


KEPT = "WHERE CAST(event_date AS TIMESTAMP) + INTERVAL 1 DAY > (SELECT max(event_time) FROM scored) - INTERVAL {}"
register(
    "t01_retention",
    retained,
    f"{S} SELECT event_date, count(*) AS n FROM scored {KEPT.format('12 DAY')} GROUP BY 1",
)


def compacted(s, sf):
    path = stored(s, sf, name="compact")
    as_of = latest_time(scored(s, sf))
    maintenance.compact(s, path, as_of)
    return s.read.parquet(path).groupBy("event_date", "source_id").agg(
        F.count("*").alias("n"), F.max("anomaly_score").alias("max_score")
    )


register(
    "t02_compaction",
    compacted,
    f"""{S} SELECT event_date, source_id, count(*) AS n, max(anomaly_score) AS max_score
    FROM scored GROUP BY 1, 2""",
)


def stream_kept(s, sf):
    path = stored(s, sf, name="stream")
    maintenance.drop_expired(
        s, path, latest_time(scored(s, sf)), maintenance.stream_retention("scored-events")
    )
    return s.read.parquet(path).select("event_id", "event_date")


register(
    "t03_stream_retention",
    stream_kept,
    f"{S} SELECT event_id, event_date FROM scored {KEPT.format('72 HOUR')}",
)
