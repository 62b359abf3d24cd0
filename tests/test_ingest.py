"""Decoding, validation, identifiers, features, sinks and maintenance."""

import datetime as dt
import json
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.functions import identity, timebuckets
from tidewarden.operators import decode, features
from tidewarden.plans import hourly, maintenance
from tidewarden.session import shared_dir
from tidewarden.sources import files, readers, sinks, synthetic
from tidewarden.sources.registry import Registry, should_promote


def raw(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_decode_and_dead_letters(spark):
    bad = ["{{broken message 7}}}", "[1,2]", "7", '"text"', "", "{", "null"]
    good = ['{"event_id":"1","source_id":"a","features":{"x":1.5},"event_time":1704067200123}', "{}"]
    d = decode.decode(raw(spark, bad + good + [None]))
    dead = decode.dead_letters(d).collect()
    assert sorted(r.raw_payload for r in dead) == sorted(bad)
    assert {r.error_type for r in dead} == {"ValueError"}
    rows = decode.normalise(d).collect()
    assert len(rows) == 2
    one = next(r for r in rows if r.event_id == "1")
    assert one.features == {"x": 1.5} and one.event_time.replace(tzinfo=dt.UTC).microsecond == 123000


def test_binary_messages(spark):
    df = spark.createDataFrame([(bytearray(b'{"event_id":"1"}'),), (bytearray(b"\x00\x00\x00\x00\x01zz"),)], "value binary")
    d = decode.decode(df)
    assert decode.normalise(d).count() == 1 and decode.dead_letters(d).count() == 1


def test_avro_bytes_written_by_hand(spark):
    from tidewarden.functions import avro
    from tidewarden.schema import RAW_EVENT_AVRO

    half = b"\x00\x00\x00\x00\x00\x00\xe0\x3f"  # 0.5
    body = b"\x04e1" + b"\x06\xc3\xa9s" + b"\x02v"
    ms = b"\x80\xd0\x8f\xa5\x98\x63"  # 1704067200000 as a zig-zag varint
    one = b"\x00\x00\x00\x00\x01" + body + b"\x02\x02k" + half + b"\x00" + ms
    sized = b"\x00\x00\x00\x00\x01" + body + b"\x01\x14\x02k" + half + b"\x00" + ms  # a block with its bytes
    empty = b"\x00\x00\x00\x00\x01" + body + b"\x00" + ms
    bad = [one[:-1], one + b"\x00", b"\x00\x00\x00\x00\x01", b"\x00{}", one[:5] + b"\x7f" + one[6:], b"\xff\xfe"]
    rows = [(m,) for m in (one, sized, empty, b'{"event_id":"j"}', *bad)]
    d = decode.decode(spark.createDataFrame(rows, "value binary"), avro_schema=RAW_EVENT_AVRO)
    good = decode.normalise(d).collect()
    got = sorted((r.event_id, r.source_id, str((r.features or {}).get("k"))) for r in good if r.event_id == "e1")
    assert got == [("e1", "és", "0.5"), ("e1", "és", "0.5"), ("e1", "és", "None")] and len(good) == 4
    assert {r.event_time.replace(tzinfo=dt.UTC).timestamp() for r in good if r.event_id == "e1"} == {1704067200.0}
    assert decode.dead_letters(d).count() == len(bad)
    # Every kind of schema, there and back.
    schema = {"type": "record", "name": "R", "fields": [
        {"name": "a", "type": ["null", "string"]}, {"name": "b", "type": {"type": "array", "items": "int"}},
        {"name": "c", "type": {"type": "enum", "name": "E", "symbols": ["X", "Y"]}}, {"name": "d", "type": "boolean"},
        {"name": "e", "type": "float"}, {"name": "f", "type": {"type": "map", "values": ["null", "long"]}},
        {"name": "g", "type": "bytes"}, {"name": "h", "type": "null"}]}
    read = avro.reader(schema)
    for value in (
        {"a": None, "b": [], "c": "Y", "d": True, "e": -0.5, "f": {}, "g": "\x00\xff", "h": None},
        {"a": "é" * 300, "b": [1, -1, 2**31 - 1, -(2**31)], "c": "X", "d": False, "e": 0.0, "f": {"k": -(2**63), "n": None}, "g": "", "h": None},
    ):
        data = avro.encode_value(value, schema)
        assert read(data, 0) == (value, len(data))


@pytest.mark.parametrize(
    "value,want",
    [
        ("null", 0.0), ("NaN", 0.0), ("Infinity", 0.0), ("-Infinity", 0.0), ('"not_a_float"', 0.0),
        ("60", 1.0), ('"60"', 1.0), ('" 60.0 "', 1.0), ('"6e1"', 1.0), ('"6_0"', 1.0), ("true", -1.95),
        ('"60f"', 0.0), ("{}", 0.0), ('""', 0.0),
    ],
)
def test_online_imputation(spark, value, want):
    d = decode.decode(raw(spark, ['{"event_id":"1","features":{"k":' + value + "}}"]))
    scaler = features.Scaler("v", ["k"], [40.0], [20.0])
    row = decode.normalise(d).select(features.scaled_vector(F.col("features"), scaler).alias("z")).first()
    assert row.z == [pytest.approx(want)]


def test_missing_features_score_as_mean(spark):
    d = decode.decode(raw(spark, ['{"event_id":"1"}', '{"event_id":"2","features":{}}']))
    scaler = features.Scaler("v", ["k", "c"], [40.0, 1.0], [20.0, 0.0], ["k"])
    rows = decode.normalise(d).select(features.scaled_vector(F.col("features"), scaler).alias("z")).collect()
    assert [r.z for r in rows] == [[0.0, 0.0]] * 2


def test_constant_feature_scale(spark):
    df = spark.createDataFrame([({"a": 5.0, "b": float(i)},) for i in range(4)], "features map<string,double>")
    s = features.fit_scaler(df, ["a", "b"], [])
    assert s.scale[0] == 1.0 and s.scale[1] == pytest.approx(np.std(range(4)))
    assert s.mean == [5.0, 1.5]


def test_safe_uuid(spark):
    u = str(uuid.uuid4())
    texts = [u, u.upper(), "{" + u + "}", u.replace("-", ""), "urn:uuid:" + u, "order 17", "ünïcode", "1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", identity.safe_uuid(F.col("t")).alias("u")).collect():
        try:
            want = str(uuid.UUID(r.t))
        except ValueError:
            want = str(uuid.uuid5(uuid.NAMESPACE_DNS, r.t))
        assert r.u == want
    blank = spark.createDataFrame([("",), (None,)], "t string").select(identity.safe_uuid(F.col("t"))).collect()
    assert all(uuid.UUID(r[0]).version == 4 for r in blank)


def test_label_and_csv(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("packet_length, Label\n1.5,BENIGN\n2.5, benign \n3.5,ATTACK\n4.5,BENIGN\n")
    df = readers.training_csv(spark, str(f), "packet_length double, ` Label` string")
    assert [r.label for r in df.orderBy("packet_length").collect()] == [0, 0, 1, 0]


def test_validation(spark):
    rows = [("a", [1.0]), ("", [1.0]), ("x" * 129, [1.0]), ("a", []), ("a", [1.0] * 1025),
            ("a", [math.nan]), ("a", [math.inf]), ("x" * 128, [0.0] * 1024), (None, [1.0]), ("a", None)]
    df = spark.createDataFrame(rows, "source_id string, feature_vector array<double>")
    ok, bad = decode.split_ingest(df)
    assert ok.count() == 2 and bad.count() == 8
    s = spark.createDataFrame([(1.5,), (-0.1,), (0.0,), (1.0,), (math.nan,), (None,)], "anomaly_score double")
    ok, bad = decode.split_scored(s)
    assert ok.count() == 2 and bad.count() == 4
    sizes = spark.createDataFrame([(0,), (1,), (1000,), (1001,)], "n int")
    assert sizes.filter(decode.batch_problem(F.col("n")).isNull()).count() == 2


def test_resolution_text():
    assert timebuckets.resolution_seconds("5m") == 300
    assert timebuckets.resolution_seconds("2D") == 172_800
    assert timebuckets.resolution_seconds("hour") == 3600
    with pytest.raises(ValueError):
        timebuckets.resolution_seconds("xm")


def scored_rows(spark, n=100, day=dt.date(2024, 1, 1)):
    t = dt.datetime(day.year, day.month, day.day, tzinfo=dt.UTC)
    rows = [
        (str(i), "s", t + dt.timedelta(minutes=i), i / 100, i > 70, t.date()) for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "event_id string, source_id string, event_time timestamp, anomaly_score double, "
        "is_anomaly boolean, event_date date",
    )


def test_insert_is_idempotent(spark):
    path = shared_dir(spark, "t")
    df = scored_rows(spark)
    sinks.insert_new(df.unionByName(df), path)
    sinks.insert_new(df, path)
    sinks.insert_new(df.limit(0), path)
    later = df.withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 1 SECOND"))
    sinks.insert_new(later.limit(10), path)  # same ids at another time are other rows
    got = spark.read.parquet(path)
    assert got.count() == 110 and got.filter("is_anomaly").count() == 29


def test_batches_are_replaced_on_retry(spark):
    path = shared_dir(spark, "b")
    df = scored_rows(spark, 10)
    for _ in range(3):
        sinks.publish(sinks.as_messages(df), path, 5)
    got = sinks.read_batches(spark, path, "key string, value string, batch_id int")
    assert got.count() == 10 and json.loads(got.orderBy("key").first().value)["event_time"] == 1704067200000


def test_retention_and_compaction(spark):
    path = shared_dir(spark, "m")
    for d in range(1, 11):
        sinks.insert_new(scored_rows(spark, 50, dt.date(2024, 1, d)), path)
        sinks.insert_new(scored_rows(spark, 80, dt.date(2024, 1, d)), path)
    before = spark.read.parquet(path).count()
    as_of = dt.datetime(2024, 1, 11, tzinfo=dt.UTC)
    done = maintenance.compact(spark, path, as_of)
    assert done == [dt.date(2024, 1, d) for d in (1, 2, 3)]
    assert maintenance.compact(spark, path, as_of) == []
    assert spark.read.parquet(path).count() == before == 800
    data = [n for n in files.children(spark, f"{path}/event_date=2024-01-01") if n.endswith(".parquet")]
    assert 1 <= len(data) <= 3
    rows = spark.read.parquet(f"{path}/event_date=2024-01-01/{data[0]}").collect()
    keys = [(r.source_id, r.is_anomaly, -r.event_time.timestamp()) for r in rows]
    assert keys == sorted(keys)
    assert files.children(spark, f"{path}/_compacting") == []
    sinks.insert_new(scored_rows(spark, 90, dt.date(2024, 1, 2)), path)  # a late file: due again
    assert maintenance.compact(spark, path, as_of) == [dt.date(2024, 1, 2)]
    gone = maintenance.drop_expired(spark, path, as_of, dt.timedelta(days=8))
    assert gone == [dt.date(2024, 1, d) for d in (1, 2)]
    assert spark.read.parquet(path).select("event_date").distinct().count() == 8
    assert maintenance.stream_retention("raw-events") == dt.timedelta(hours=24)


def test_compaction_keeps_files_written_meanwhile(spark, monkeypatch):
    path = shared_dir(spark, "race")
    sinks.insert_new(scored_rows(spark, 50), path)
    move, late = files.move, []

    def slow_move(*args):
        if not late:
            late.append(1)
            sinks.insert_new(scored_rows(spark, 60), path)
        move(*args)

    monkeypatch.setattr(files, "move", slow_move)
    maintenance.compact(spark, path, dt.datetime(2024, 2, 1, tzinfo=dt.UTC))
    got = spark.read.parquet(path)
    assert got.count() == got.select("event_id").distinct().count() == 60


def test_refresh_replaces_only_its_hours(spark, scored):
    path = shared_dir(spark, "h")
    as_of = dt.datetime(2024, 1, 10, 12, 30, tzinfo=dt.UTC)
    hourly.refresh(scored, path, as_of, full=True)
    full = hourly.read_partials(spark, path).drop("bucket_hour")
    full_rows = full.collect()
    # Late rows for an hour in range, and one for an hour out of range.
    extra = scored.limit(2).withColumn(
        "event_time", F.when(F.col("event_id") == scored.first().event_id, F.lit(as_of - dt.timedelta(hours=2)))
        .otherwise(F.lit(as_of - dt.timedelta(hours=20)))
    ).withColumn("event_date", F.lit(dt.date(2024, 1, 10)))
    assert hourly.refresh_range(as_of) == (
        dt.datetime(2024, 1, 10, 10, tzinfo=dt.UTC), dt.datetime(2024, 1, 10, 11, tzinfo=dt.UTC)
    )
    hourly.refresh(scored.unionByName(extra), path, as_of)
    now = hourly.read_partials(spark, path).agg(F.sum("event_count")).first()[0]
    assert now == sum(r.event_count for r in full_rows) + 1


def test_registry(spark):
    r = Registry(spark, shared_dir(spark, "reg"))
    assert r.resolve("scaler") == "default" and r.active() == "dummy-v0"
    r.save("scaler", "20240101_000000", features.fallback_scaler().to_df(spark))
    r.save("scaler", "20231231_000000", features.fallback_scaler().to_df(spark))
    assert r.resolve("scaler") == "20240101_000000"
    back = features.Scaler.from_df(r.load("scaler", "20240101_000000"), "20240101_000000")
    assert back.names == features.fallback_scaler().names and len(back.skewed) == 5
    with pytest.raises(LookupError):
        r.load("scaler", "nope")
    assert [should_promote(n, 0.95) for n in (0.96, 0.95, 0.94)] == [True, True, False]


def test_synthetic(spark):
    now = dt.datetime(2024, 1, 8, tzinfo=dt.UTC)
    e = synthetic.synthetic_events(spark, 4000, now)
    share = e.filter("injected_anomaly").count() / 4000
    assert 0.03 < share < 0.07 and e.select("source_id").distinct().count() == 20
    assert e.select(F.size("feature_vector")).distinct().collect()[0][0] == 10
    t = synthetic.seed_table(spark, now)
    assert t.count() == 1000 and t.filter("is_anomaly").count() == 300
    assert t.select("source_id").distinct().count() == 5
    assert t.select("model_version").distinct().count() == 3
    assert t.filter("is_anomaly <> (anomaly_score >= 0.7)").count() == 0
    lag = F.unix_micros("processed_at") - F.unix_micros("event_time")
    assert t.filter(~lag.between(50_000, 500_000)).count() == 0
    again = synthetic.seed_table(spark, now).repartition(3).drop("features")
    assert t.drop("features").exceptAll(again).count() == 0


def test_broken_compaction_is_finished_by_the_next(spark, monkeypatch, tmp_path):
    path, end = str(tmp_path / "t"), dt.datetime(2024, 2, 1, tzinfo=dt.UTC)
    day = "SELECT id AS event_id, 's' AS source_id, true AS is_anomaly, timestamp '2024-01-01' AS event_time, date '2024-01-01' AS event_date FROM range(50)"
    spark.sql(day).repartition(3).write.partitionBy("event_date").parquet(path)
    real, calls = maintenance.files.move, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == 3:
            raise OSError("lost")
        real(*args)

    monkeypatch.setattr(maintenance.files, "move", breaks)
    with pytest.raises(OSError):
        maintenance.compact(spark, path, end)
    monkeypatch.setattr(maintenance.files, "move", real)
    assert maintenance.recover(spark, path) == 1
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == list(range(50))
    assert maintenance.compact(spark, path, end) == [] and maintenance.recover(spark, path) == 0
    # One that broke off before it was complete leaves everything as it was.
    (tmp_path / "t" / "_compacting" / "x" / "new").mkdir(parents=True)
    assert maintenance.recover(spark, path) == 1 and spark.read.parquet(path).count() == 50


def test_a_late_row_reads_its_own_time(spark, scored):
    rows = scored.orderBy("event_time").limit(40).union(scored.orderBy(F.desc("event_time")).limit(1))
    near = scored.filter(sinks._near(rows, "event_date"))
    assert rows.join(near, "event_id").count() == 41 and near.count() < scored.count() / 2
    assert sinks._near(rows.limit(0), "event_date") is None


def test_insert_of_scattered_hours_keeps_its_plan_small(spark, monkeypatch):
    """10 000 separate hours, then the same again with one more: ranges, not one literal per hour."""
    path, seen, near = shared_dir(spark, "scattered"), [], sinks._near

    def spans(new, day):
        seen.append(near(new, day))
        return seen[-1]

    monkeypatch.setattr(sinks, "_near", spans)
    t0 = dt.datetime(2020, 1, 1, tzinfo=dt.UTC)
    at = F.timestamp_micros(F.lit(int(t0.timestamp() * 1e6)) + F.col("id") * 3 * 3_600_000_000)
    rows = lambda n: spark.range(n).select(
        F.col("id").cast("string").alias("event_id"), at.alias("event_time"), F.date_trunc("month", at).cast("date").alias("event_date")
    )
    sinks.insert_new(rows(10_000), path)
    sinks.insert_new(rows(10_001), path)
    assert spark.read.parquet(path).count() == 10_001
    assert len(str(seen[0])) < 200 * sinks.SPANS * 4
    few = near(rows(100), "event_date")
    assert len(str(seen[0])) < 3 * len(str(few))


def test_alert_insert_of_scattered_days(spark):
    path, topic = shared_dir(spark, "alerts"), shared_dir(spark, "alert-topic")
    at = F.timestamp_seconds(F.col("id") * 86_400 * 5)
    rows = lambda n: spark.range(n).select(F.col("id").cast("string").alias("alert_id"), at.alias("created_at"))
    sinks.write_alerts(rows(40), path, topic, 0)
    sinks.write_alerts(rows(60), path, topic, 1)
    assert spark.read.parquet(path).count() == 60


def test_published_ids_are_not_cut(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["s15_publish_long_ids"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    long = [r for r in rows if r.id_length and r.id_length > 128]
    assert long and {r.problem for r in long} == {"source_id must have 1 to 128 characters"}
    assert any(r.problem is None for r in rows) and all(r.id_length <= 128 for r in rows if r.problem is None)


def test_critical_annotations_tell_the_score(spark, scored):
    import __spark_entry__ as entry

    rows = entry.queries()["s14_critical_annotations"](spark, "/root/testdata/sf0.001").collect()
    want = [f"CRITICAL Anomaly (Score: {r.anomaly_score})" for r in scored.filter("anomaly_score >= 0.95").collect()]
    assert want and sorted(r.text for r in rows) == sorted(want)


def test_avro_messages_are_read_once(spark, tmp_path):
    """Good and refused rows come of one pass: one call of the writer and one of the reader."""
    import registered.ingest as r

    rows = [(i, dt.datetime(2024, 1, 1, 0, i, tzinfo=dt.UTC), i, "view", v, '{"k": 7}') for i, v in enumerate((1.0, 210.0, 260.0, 310.0))]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    d = r.avro_decoded(spark, str(tmp_path))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    got = {x.event_id: (x.source_id, x.k, x.value, x.bad) for x in d.filter("bad is null").collect()}
    assert got == {"0": ("sourcé-0", 7.0, 1.0, None), "1": ("sourcé-1", 7.0, 210.0, None)}
    refused = d.filter("bad is not null").collect()
    assert [tuple(x) for x in refused] == [(None,) * 6 + ("Cannot deserialise message as Avro or JSON",)] * 2


def test_scaling_is_one_expression_for_all_features(spark):
    """Written out per feature, the generated method is beyond what the JVM compiles."""
    names = [f"n{i}" for i in range(30)]
    scaler = features.Scaler("v", names, [1.0] * 30, [2.0] * 29 + [0.0], names)
    df = spark.createDataFrame([({"n0": 2.0, "n1": -3.0, "n2": float("nan"), "n29": 5.0},)], "features map<string,double>")
    z = df.select(features.scaled_vector(F.col("features"), scaler).alias("z"))
    assert z._jdf.queryExecution().analyzed().toString().upper().count("LOG1P") <= 2
    assert z.first().z == [(math.log1p(2.0) - 1) / 2, -0.5] + [0.0] * 28
