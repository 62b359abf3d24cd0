"""Streaming jobs against their batch twins."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from registered.common import scored as scored_view
from registered.ingest import messages
from tidewarden.functions.severity import AlertThresholds
from tidewarden.operators import alerts, decode, drift, forest, half_space
from tidewarden.plans import hourly, maintenance, queries, retrain
from tidewarden.sources import readers, sinks
from tidewarden.sources.registry import Registry
from tidewarden.streaming import alerting, batching, keyed, mergeable, scoring, windows

SF = "/root/testdata/sf0.001"


def folder(spark, name):
    from tidewarden.session import shared_dir

    return shared_dir(spark, name)


def collect_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = q.option("checkpointLocation", folder(df.sparkSession, f"cp-{name}")).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture()
def event_files(spark):
    """The scored view as a folder of files in time order."""
    path = folder(spark, "files")
    e = scored_view(spark, SF).withColumn("metadata", F.create_map().cast("map<string,string>"))
    e = e.withColumn("severity", F.lit("LOW"))
    days = [r[0] for r in e.select("event_date").distinct().orderBy("event_date").collect()]
    for day in days[:6]:
        e.filter(F.col("event_date") == day).coalesce(1).write.mode("append").parquet(path)
    return path, e.filter(F.col("event_date").isin(days[:6]))


def test_scoring_end_to_end_and_replay(spark):
    raw, out = folder(spark, "raw"), folder(spark, "out")
    msgs = messages(spark, SF)
    msgs.repartition(4).write.text(raw)
    r = Registry(spark, folder(spark, "registry"))
    to = scoring.Targets(f"{out}/table", f"{out}/topic", f"{out}/dead", f"{out}/cp")
    stream = readers.raw_stream(spark, raw, max_per_trigger=1)
    scoring.start_scoring(stream, r, to, ["k", "value"]).awaitTermination()
    decoded = decode.decode(msgs)
    good = decoded.filter("bad is null").count()
    # An empty line is a message to the text source as well.
    bad = decoded.filter("bad is not null").count()
    table = spark.read.parquet(to.table)
    assert table.count() == good
    # A null value is written as an empty line, which the text source hands on.
    empty = msgs.filter("value is null").count()
    assert spark.read.parquet(to.dead_letters).count() == bad + empty
    rows = table.agg(F.min("anomaly_score"), F.max("anomaly_score"), F.count_if("is_anomaly")).first()
    assert rows[0] >= 0.05 and rows[1] <= 0.35 and rows[2] == 0
    assert {x[0] for x in table.select("model_version").distinct().collect()} == {"dummy-v0"}

    # The same messages once more, under a new checkpoint: nothing is added.
    again = scoring.Targets(to.table, to.topic, to.dead_letters, f"{out}/cp2")
    stream = readers.raw_stream(spark, raw, max_per_trigger=2)
    scoring.start_scoring(stream, r, again, ["k", "value"]).awaitTermination()
    assert spark.read.parquet(to.table).count() == good


def test_a_batch_holds_the_text_of_unread_messages_only(spark, monkeypatch):
    """Of a message that was read, only the record is held between the writes; dead letters keep their text."""
    out, held, real = folder(spark, "slim"), [], decode.dead_letters
    monkeypatch.setattr(scoring.decode, "dead_letters", lambda d, *a: held.append(d) or real(d, *a))
    texts = ['{"event_id":"a","source_id":"s","features":{"k":1.5},"event_time":1704067200000}', "{broken", "[1]"]
    msgs = spark.createDataFrame([(t,) for t in texts], "value string")
    to = scoring.Targets(f"{out}/table", f"{out}/topic", f"{out}/dead", f"{out}/cp")
    scoring.score_batch(msgs, 0, scoring.Scorer(Registry(spark, f"{out}/registry")), to, ["k"])
    assert set(held[0].columns) == {"event", "bad", "payload"}
    assert sorted(r.payload for r in held[0].collect() if r.payload is not None) == sorted(texts[1:])
    dead = spark.read.parquet(to.dead_letters)
    assert sorted(r.raw_payload for r in dead.collect()) == sorted(texts[1:])
    assert [r.source_id for r in spark.read.parquet(to.table).collect()] == ["s"]


@pytest.mark.parametrize("size", [2, 5, 64])
def test_a_forest_equals_the_walk_of_every_row(size):
    rng = np.random.default_rng(size)
    depth = max(1, int(np.ceil(np.log2(size))))
    grown = [forest.grow_tree(rng.integers(0, 9, (size, 3)).astype(float), depth, rng) for _ in range(7)]
    arrays = forest._empty(len(grown), size)
    for tree, nodes in enumerate(grown):
        for node, *values in nodes:
            for array, value in zip(arrays, values):
                array[tree, node] = value
    model = forest.Forest("v", size, 0.1, 0.0, *arrays)
    x = rng.integers(-1, 10, (5000, 3)).astype("float32")
    x[::7, 1] = np.nan
    total = np.zeros(len(x))
    for nodes in grown:
        by_node = {n[0]: n[1:] for n in nodes}
        for i, row in enumerate(x):
            at = 0
            while by_node[at][2] != at:
                feature, cut, child, _ = by_node[at]
                at = child + bool(row[feature] > cut)
            total[i] += by_node[at][3]
    want = -np.exp2(-(total / len(grown)) / max(forest.average_path(size), 1e-12))
    assert np.array_equal(model.score_samples(x), want)


def test_model_swap_between_batches(spark):
    e = scored_view(spark, SF)
    r = Registry(spark, folder(spark, "registry"))
    as_of = dt.datetime(2024, 1, 31, tzinfo=dt.UTC)
    version = retrain.retrain(r, e, as_of, trees=10, at_least=50)
    assert version == "20240131_000000" == r.active() == r.resolve("forest")
    scorer = scoring.Scorer(r)
    batch = e.select("event_id", "source_id", "event_type", "event_time", "features", "feature_vector")
    first = scorer.score(batch)
    assert first.select("model_version").distinct().collect()[0][0] == version
    assert first.filter("anomaly_score not between 0 and 1").count() == 0
    r.activate("dummy-v0", as_of + dt.timedelta(hours=1))
    assert scorer.score(batch).select("model_version").distinct().collect()[0][0] == "dummy-v0"
    with pytest.raises(LookupError):
        r.rollback("20200101_000000", as_of, "no such version", "forest")
    r.rollback(version, as_of + dt.timedelta(hours=2), "better", "forest")
    assert r.active() == version


def test_control_stream_moves_the_pointer(spark):
    e = scored_view(spark, SF)
    r = Registry(spark, folder(spark, "registry"))
    for day in (20, 31):
        retrain.retrain(r, e, dt.datetime(2024, 1, day, tzinfo=dt.UTC), trees=5, at_least=10)
    assert r.active() == "20240131_000000"
    path = folder(spark, "control")
    t0 = dt.datetime(2024, 2, 1, tzinfo=dt.UTC)

    def send(i, text):
        df = spark.createDataFrame([(text, t0 + dt.timedelta(minutes=i))], "value string, event_time timestamp")
        df.coalesce(1).write.mode("append").parquet(path)

    def follow():
        stream = spark.readStream.schema("value string, event_time timestamp").parquet(path)
        scoring.start_control(stream, r, path + "-cp").awaitTermination()
        return r.active()

    send(0, '{"command":"ROLLBACK","target_version":"20240120_000000"}')
    assert follow() == "20240120_000000"
    send(1, '{"action":"reload","version":"nothing_stored"}')
    send(2, "not json")
    assert follow() == "20240120_000000"
    send(3, '{"model_version":"20240131_000000"}')
    assert follow() == "20240131_000000"


def test_alerting_stream_equals_batch(spark, event_files):
    files, e = event_files
    out = folder(spark, "alerting")
    sinks.insert_new(e, f"{out}/scored")
    settings = AlertThresholds(low=0.1, high=0.3, burst_limit=2)
    wide = 6 * 3_600_000
    rules = alerts.effective_silences(
        alerts.silence_rows(
            e.filter("event_type = 'error'").select(
                "source_id", F.lit(300).alias("duration_minutes"), F.lit("x").alias("reason"),
                F.col("event_time").alias("created_at"),
            )
        )
    )
    e = e.withColumn("is_anomaly", F.col("anomaly_score") >= 0.2)
    sinks.insert_new(e, f"{out}/flagged")
    a = alerting.Alerter(
        f"{out}/flagged", f"{out}/alerts", f"{out}/topic", f"{out}/notes", f"{out}/cp",
        silences=lambda: rules, thresholds=lambda: settings, window_ms=wide, chunk_ms=2 * wide,
    )
    topic = f"{out}/source"
    for day in range(6):
        part = e.filter(F.col("event_date") == dt.date(2024, 1, 1 + day))
        part.coalesce(1).write.mode("append").parquet(topic)
    stream = readers.scored_stream(spark, topic, max_files=1)
    alerting.start_alerting(stream, a).awaitTermination()
    batch = alerts.build_alerts(e, rules, settings, None, wide, 2 * wide)
    key = ["alert_id", "event_id", "severity", "burst_count", "score"]
    got = spark.read.parquet(a.alert_table).select(key)
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch.select(key)).count() == 0
    published = sinks.read_batches(spark, f"{out}/topic", "key string, value string, batch_id int")
    assert published.count() == batch.count()
    # A retried batch adds nothing to the table.
    alerting.alert_batch(spark.read.parquet(topic), 0, a)
    assert spark.read.parquet(a.alert_table).count() == batch.count()


def test_a_part_of_the_event_files_is_work_for_many_tasks(spark):
    """Four parts that follow one another in time, each in more files than four; no row without a time."""
    from registered import streams

    sf, t0 = folder(spark, "many-files"), dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 50 == 7 else t0 + dt.timedelta(seconds=i * 37 % 4001), i % 5, "view", float(i % 300), '{"k": 3}')
            for i in range(2000)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/events.parquet")
    path, e = streams.event_files(spark, sf)
    found = spark.read.parquet(path).select("event_id", "event_time", F.col("_metadata.file_path").alias("file"),
                                            F.col("_metadata.file_modification_time").alias("at"))
    files = found.groupBy("file", "at").agg(F.min("event_time").alias("low"), F.max("event_time").alias("high")).collect()
    files = sorted(files, key=lambda f: (f.at, f.low))
    assert len(files) == 4 * streams.FILES >= 4 * 8
    parts = [files[i : i + streams.FILES] for i in range(0, len(files), streams.FILES)]
    for a, b in zip(parts, parts[1:]):
        assert max(f.high for f in a) < min(f.low for f in b) and max(f.at for f in a) <= min(f.at for f in b)
    want = sorted(r.event_id for r in e.filter("event_time is not null").select("event_id").collect())
    assert sorted(r.event_id for r in found.collect()) == want and len(want) == 1960


def test_a_retried_alert_batch_counts_on_the_same_files(spark, event_files):
    files, e = event_files
    out, wide = folder(spark, "retried"), 24 * 3_600_000
    e = e.withColumn("is_anomaly", F.lit(True))
    early = F.col("event_id").cast("int") % 3 > 0
    sinks.insert_new(e.filter(early), f"{out}/scored")
    a = alerting.Alerter(
        f"{out}/scored", f"{out}/alerts", f"{out}/topic", f"{out}/notes", f"{out}/cp",
        thresholds=lambda: AlertThresholds(low=0.05, high=0.1, burst_limit=2), window_ms=wide, chunk_ms=wide,
    )
    counts = lambda n: {
        (r.event_id, r.burst_count) for r in alerting.alerts_of_batch(e.filter(early), n, a).collect()
    }
    first = counts(0)
    sinks.insert_new(e.filter(~early), f"{out}/scored")
    assert counts(0) == first and first
    # The next batch sees the new rows; lists older than one batch are dropped.
    assert counts(1) != first and counts(2) == counts(1)
    assert alerting.files.children(spark, f"{out}/cp-context") == ["1", "2"]
    # A day that was rewritten meanwhile is read as it is, without a loss.
    later = counts(2)
    maintenance.compact(spark, f"{out}/scored", dt.datetime(2025, 1, 1, tzinfo=dt.UTC))
    assert counts(2) == later
    empty = alerting.Alerter(f"{out}/none", f"{out}/a", f"{out}/t", f"{out}/n", f"{out}/cp2")
    assert alerting.alerts_of_batch(e, 0, empty).count() == 0


def test_the_clock_speaks_where_events_are_silent(spark):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    # Two minutes all anomalous, silence, then one normal event.
    rows = [(at(s), True) for s in range(0, 300, 5)] + [(at(1_000), False)]
    e = spark.createDataFrame(rows, "event_time timestamp, is_anomaly boolean")
    ticks = spark.createDataFrame([(at(s),) for s in list(range(0, 1_200, 10)) * 2], "eval_time timestamp")
    judged = queries.rate_rule_at(e, ticks).withColumn("at", F.unix_seconds("eval_time") - int(at(0).timestamp()))
    got = {r["at"]: (r.anomaly_rate, r.state) for r in judged.collect()}
    assert len(got) == 120
    for s in range(0, 1_200, 10):
        inside = [a for t, a in rows if at(s - 120) <= t < at(s)]
        rate = round(100 * sum(inside) / len(inside), 2) if inside else None
        above = [any(a for t, a in rows if at(x - 120) <= t < at(x)) for x in range(s - 120, s + 1, 10)]
        state = "NoData" if rate is None else "Normal" if rate <= 5 else "Firing" if all(above) else "Pending"
        assert got[s] == (rate, state), s
    assert {s for _, s in got.values()} == {"NoData", "Normal", "Firing", "Pending"}
    live = ticks.withColumnRenamed("eval_time", "tick")
    found = {r.events_per_second: r.anomaly_rate_percent for r in queries.live_metrics_at(e, live).collect()}
    assert found[0.2] == 100.0 and found[0.1] == 0.0 and 0.0 in found
    for empty in (queries.rate_rule_at(e, ticks.limit(0)), queries.live_metrics_at(e.limit(0), live.limit(0))):
        assert empty.count() == 0
    assert {r.state for r in queries.rate_rule_at(e.limit(0), ticks).collect()} == {"NoData"}
    clock = windows.clock_stream(spark)
    assert clock.isStreaming and clock.dtypes == [("at", "timestamp")]


def test_burst_state_equals_batch(spark, event_files):
    files, e = event_files
    wide = 12 * 3_600_000
    stream = keyed.burst_stream(readers.scored_stream(spark, files, 1), 0.2, wide)
    got = {r.event_id: r.burst_count for r in collect_stream(stream, "bursts").collect()}
    batch = alerts.burst_counts(e, 0.2, wide, 2 * wide)
    want = {r.event_id: r.burst_count for r in batch.select("event_id", "burst_count").collect()}
    assert got == want and max(want.values()) > 1


def state_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()


def test_burst_state_goes_by_event_time(spark):
    """Ten sources fall silent; once the watermark is a window and 10 s on, only the live one is held."""
    path, cp = folder(spark, "expiry"), folder(spark, "cp-expiry")
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    sec = lambda n: t0 + dt.timedelta(seconds=n)
    schema = "source_id string, event_id string, event_time timestamp, anomaly_score double"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = keyed.burst_stream(spark.readStream.schema(schema).parquet(path), 0.9, 60_000, expire=True)
        q = stream.writeStream.format("parquet").option("path", path + "-out").option("checkpointLocation", cp)
        q.trigger(availableNow=True).start().awaitTermination()
        return state_rows(spark, cp, "seen")

    assert run([(f"s{i}", f"{i}-{k}", sec(i + k), 0.95) for i in range(10) for k in range(3)]) == 10
    # The watermark is at 78 s after this: windows and slack end at 72 s and later.
    assert run([("live", "a", sec(88), 0.95)]) == 1 + 10 - 7
    assert run([("live", "b", sec(300), 0.95), ("s0", "c", sec(301), 0.95)]) == 2
    got = {r.event_id: r.burst_count for r in spark.read.parquet(path + "-out").collect()}
    assert got["0-2"] == got["9-2"] == 3 and got["a"] == got["b"] == got["c"] == 1


@pytest.mark.parametrize("expire", [False, True])
def test_burst_state_is_called_per_bucket_not_per_source(spark, expire):
    """1500 sources, one of them null, in two batches: the counts of a loop, from far fewer keys."""
    path, cp = folder(spark, "many"), folder(spark, "cp-many")
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    schema = "source_id string, event_id string, event_time timestamp, anomaly_score double"
    rng, rows = np.random.default_rng(5), []
    for part in range(2):
        new = [
            (None if s == 7 else f"s{s}", f"{part}-{s}-{k}", t0 + dt.timedelta(seconds=30 * part + int(rng.integers(0, 30))),
             float(rng.choice([0.2, 0.95])))
            for s in range(1500) for k in range(2)
        ]
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(path)
        rows += new
        stream = keyed.burst_stream(spark.readStream.schema(schema).parquet(path), 0.9, 20_000, expire=expire)
        q = stream.writeStream.format("parquet").option("path", path + "-out").option("checkpointLocation", cp)
        q.trigger(availableNow=True).start().awaitTermination()
    own, want = {}, {}
    for source, event, at, score in sorted(rows, key=lambda r: (r[2], r[1])):
        times = own.setdefault(source, [])
        times += [at] if score >= 0.9 else []
        want[(source, event)] = sum(at - dt.timedelta(seconds=20) < t for t in times)
    got = {(r.source_id, r.event_id): r.burst_count for r in spark.read.parquet(path + "-out").collect()}
    assert got == want and max(want.values()) > 2
    held = spark.read.format("statestore").option("stateVarName", "seen").load(cp)
    assert 0 < held.select("key").distinct().count() < 1000


def slow_batches(rows, size, wait):
    """Row by row, as one writer with a buffer would do it; the last batch is still open."""
    out, held, since = [], [], None
    for t, name in sorted(rows):
        if held and (len(held) >= size or t >= since + wait):
            out.append(held)
            held = []
        since = t if not held else since
        held.append(name)
    return out + [held] if len(held) >= size else out


@pytest.mark.parametrize("size,wait", [(500, 100), (7, 1000), (1, 100), (3, 1)])
def test_batch_cuts_equal_a_buffer(size, wait):
    rng = np.random.default_rng(size)
    ms = np.sort(np.concatenate([rng.integers(0, 5000, 1500), np.full(700, 2500)]))
    got = [list(range(a, b)) for a, b in batching.cuts(ms, size, wait, -1)]
    assert got == slow_batches(list(zip(ms, range(len(ms)))), size, wait)
    # With the clock beyond everything, nothing is held back.
    assert sum(b - a for a, b in batching.cuts(ms, size, wait, 10**6)) == len(ms)


class Lane:
    """What a lane keeps between two micro-batches, in memory."""

    def __init__(self):
        self.kept, self.timers = {}, set()

    def getListState(self, name, schema):
        return Kept(self.kept, name)

    getValueState = getListState

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class Kept:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def exists(self):
        return self.name in self.kept

    def get(self):
        return self.kept[self.name]

    def put(self, value):
        self.kept[self.name] = value

    update = put

    def clear(self):
        self.kept.pop(self.name, None)


def test_many_write_batches_go_out_as_one_frame():
    """60 000 rows in batches of 2: equal to the buffer, without a frame for each batch."""
    import time

    rng, lane = np.random.default_rng(3), Lane()
    writer = batching.WriteBatches(2, 1000, False)
    writer.init(lane)
    ms = np.sort(rng.integers(0, 600_000, 60_000))
    rows = pd.DataFrame({"ms": ms, "event_id": [f"{i:05d}" for i in range(len(ms))], "value": "x"})
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: -1)
    started, out = time.perf_counter(), []
    for a, b in [(0, 1), (1, 30_000), (30_000, 60_000)]:
        out += list(writer.handleInputRows((4,), iter([rows.iloc[a:b]]), clock))
    assert time.perf_counter() - started < 4
    got = pd.concat(out)
    assert list(got.columns) == ["lane", "batch", "size", "event_id", "value"] and set(got["lane"]) == {4}
    batches = got.groupby("batch")["event_id"].agg(list)
    assert list(batches) == slow_batches(list(zip(rows["ms"], rows["event_id"])), 2, 1000)
    assert list(batches.index) == list(range(len(batches)))
    assert (got.groupby("batch")["size"].agg(["min", "max"]).T == batches.map(len)).all(axis=None)
    # What is left waits for its timer.
    left = list(writer.handleExpiredTimer((4,), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 10**9)))
    assert len(got) + sum(len(f) for f in left) == len(rows) and not lane.timers and "held" not in lane.kept


def test_write_batches_by_the_clock(spark):
    """1203 rows at once: two full batches at once, the rest by the timer without further input."""
    import time

    path, out = folder(spark, "lane"), folder(spark, "lane-out")
    e = spark.range(1203).select(
        F.col("id").cast("string").alias("event_id"), F.timestamp_seconds("id").alias("event_time"), F.lit("x").alias("v")
    )
    e.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(e.schema).parquet(path)
    batches = batching.write_batches(stream, F.col("v"), F.lit(0))
    q = batches.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "cp-lane"))
    q = q.trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(240):
            time.sleep(0.5)
            if q.exception() or (q.lastProgress and spark.read.schema(batches.schema).parquet(out).count() == 1203):
                break
    finally:
        q.stop()
    got = spark.read.schema(batches.schema).parquet(out).groupBy("batch").agg(F.count("*").alias("n"), F.max("size").alias("s"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 500, 500), (1, 500, 500), (2, 203, 203)]


def test_half_space_stream_equals_batch(spark, event_files):
    files, e = event_files
    p = half_space.Params(trees=5, height=4, window=10)
    stream = keyed.half_space_stream(
        readers.scored_stream(spark, files, 1), "event_type", "feature_vector", 2, p
    )
    got = {r.event_id: r.score for r in collect_stream(stream, "hst").collect()}
    batch = half_space.batch_scores(e, "event_type", "feature_vector", 2, params=p, windows_per_task=2)
    want = {r.event_id: r.score for r in batch.collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], [want[k] for k in want])
    assert max(want.values()) > 0


def test_one_key_over_many_tasks_equals_the_loop(spark, event_files):
    """All events under one key, in six micro-batches: state merged from windows, not held by a task."""
    files, e = event_files
    out, p = folder(spark, "one-key"), half_space.Params(trees=5, height=4, window=10)
    stream = readers.scored_stream(spark, files, 1).withColumn("one", F.lit("k"))
    mergeable.start_half_space(stream, f"{out}/o", f"{out}/s", f"{out}/c", "one", "feature_vector", 2, p).awaitTermination()
    got = sinks.read_batches(spark, f"{out}/o", "key string, event_id string, position bigint, score double")
    rows = {r.event_id: (r.position, r.score) for r in got.collect()}
    batches = {r.event_id: r.batch_id for r in spark.read.parquet(f"{out}/o").select("event_id", "batch_id").collect()}
    ms = F.unix_millis("event_time")
    order = [r for r in e.select("event_id", "feature_vector", ms.alias("ms")).collect()]
    order.sort(key=lambda r: (batches[r.event_id], r.ms, r.event_id))
    x = np.array([r.feature_vector for r in order])
    want = half_space.fold(half_space.State.start(x[0], p), x, half_space.grow(2, p), p)
    assert [rows[r.event_id][0] for r in order] == list(range(len(order))) and max(batches.values()) == 5
    assert np.allclose([rows[r.event_id][1] for r in order], want) and want.max() > 0


def test_a_repeated_batch_changes_nothing(spark, event_files):
    files, e = event_files
    out, wide = folder(spark, "again"), 12 * 3_600_000
    days = [r[0] for r in e.select("event_date").distinct().orderBy("event_date").collect()]
    state = mergeable.Versions(spark, f"{out}/s", mergeable.BURST_ROWS)
    trees = mergeable.Versions(spark, f"{out}/t", half_space.STATE)
    p = half_space.Params(trees=3, height=3, window=8)
    for i, day in enumerate(days):
        part = e.filter(F.col("event_date") == day)
        for _ in range(2 if i in (1, 4) else 1):
            mergeable.burst_batch(part, i, state, f"{out}/b", 0.2, wide, 20)
            mergeable.half_space_batch(part, i, trees, f"{out}/h", "event_type", "feature_vector", 2, p, None)
    got = sinks.read_batches(spark, f"{out}/b", "source_id string, event_id string, burst_count bigint")
    want = {r.event_id: r.burst_count for r in alerts.burst_counts(e, 0.2, wide, 2 * wide).collect()}
    assert {r.event_id: r.burst_count for r in got.collect()} == want and got.count() == len(want)
    got = sinks.read_batches(spark, f"{out}/h", "key string, event_id string, position bigint, score double")
    want = {r.event_id: r.score for r in half_space.batch_scores(e, "event_type", "feature_vector", 2, params=p).collect()}
    got = {r.event_id: r.score for r in got.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], [want[k] for k in want])
    # Empty batches pass, and keys that are not in a batch keep their state.
    before = trees.before(99).orderBy("key").collect()
    mergeable.half_space_batch(e.limit(0), 98, trees, f"{out}/h", "event_type", "feature_vector", 2, p, None)
    assert trees.before(99).orderBy("key").collect() == before


@pytest.mark.parametrize("threshold,minimum", [(0.5, 3), (3.0, 30), (1e9, 1)])
def test_drift_fold_equals_the_loop(threshold, minimum):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, 4000) for m in (0, 1, 1, -2, 0)])
    p, s, loop, hits = drift.Params(min_instances=minimum, threshold=threshold), drift.State(), drift.State(), []
    want = [i for i, v in enumerate(x) if drift.update(loop, float(v), p)]
    for a in range(0, len(x), 777):
        s, at = drift.fold(s, x[a : a + 777], p)
        hits += (at + a).tolist()
    assert hits == want and (s.n, round(s.up, 6), round(s.down_max, 6)) == (loop.n, round(loop.up, 6), round(loop.down_max, 6))
    assert bool(want) == (threshold < 1e6)


def test_drift_stream_equals_batch(spark, event_files):
    files, e = event_files
    p = drift.Params(min_instances=10, threshold=1.0)
    stream = keyed.drift_stream(readers.scored_stream(spark, files, 1), "event_type", "anomaly_score", p)
    got = {(r.key, r.event_id) for r in collect_stream(stream, "drift").collect()}
    batch = drift.batch_drifts(e, "event_type", "anomaly_score", params=p, block_rows=7)
    assert got == {(r.event_type, r.event_id) for r in batch.collect()} and got


def test_hourly_stream_equals_batch(spark, event_files):
    files, e = event_files
    path = folder(spark, "hourly")
    stream = readers.scored_stream(spark, files, 1)
    windows.start_hourly(stream, path, folder(spark, "cp-hourly")).awaitTermination()
    got = hourly.read_partials(spark, path).drop("bucket_hour", "score_sum")
    want = hourly.hourly_partials(e).drop("score_sum")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_an_hour_of_the_hourly_stream_is_one_file(spark, event_files):
    """Not one of every task: hours times tasks would be the number of files."""
    path = folder(spark, "hourly-files")
    windows.start_hourly(readers.scored_stream(spark, event_files[0], 1), path, folder(spark, "cp-hourly-files")).awaitTermination()
    names = [r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()]
    hours = hourly.read_partials(spark, path).select("bucket_hour").distinct().count()
    assert len(names) == hours > 1


def test_windowed_streams(spark, event_files):
    files, e = event_files
    rate = windows.ingestion_stream(readers.scored_stream(spark, files, 1))
    total = collect_stream(rate, "rate", "complete").agg(F.sum("events_per_sec")).first()[0]
    assert round(total * 10) == e.count()
    live = windows.live_metrics_stream(readers.scored_stream(spark, files, 1))
    rows = collect_stream(live, "live").collect()
    want = {r.tick: r for r in queries.live_metrics_series(e).collect()}
    assert 0.5 * len(want) < len(rows) and all(want[r.tick] == r for r in rows)


def test_events_without_time_are_dated_by_arrival(spark):
    raw, out = folder(spark, "raw"), folder(spark, "out")
    lines = [('{"event_id":"1","features":{"k":1}}',), ('{"features":{"k":2},"event_time":1e300}',)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(raw)
    r = Registry(spark, folder(spark, "registry"))
    for attempt in range(2):  # the second run replays the first
        to = scoring.Targets(f"{out}/table", f"{out}/topic", f"{out}/dead", f"{out}/cp{attempt}")
        scoring.start_scoring(readers.raw_stream(spark, raw), r, to).awaitTermination()
    assert spark.read.parquet(f"{out}/table").count() == 2


def test_feed(spark, event_files):
    from tidewarden.operators import notify

    files, e = event_files
    out = folder(spark, "feed")
    feed = notify.live_feed(readers.scored_stream(spark, files, 3))
    scoring.start_feed(feed, out, folder(spark, "cp-feed")).awaitTermination()
    assert spark.read.json(out).count() == e.count()


def test_replay_stream(spark):
    path = folder(spark, "csv")
    spark.range(40).select("id", (F.col("id") * 1.5).alias("packet_length")).repartition(4).write.option(
        "header", "true"
    ).csv(path)
    events = readers.replay_stream(spark, path, "id bigint, packet_length double", F.col("id"))
    rows = collect_stream(events, "replay")
    assert rows.count() == 40
    assert rows.select("source_id").distinct().collect()[0][0] == "cicids-replay"
    assert rows.agg(F.sum(F.col("features")["packet_length"])).first()[0] == 1.5 * sum(range(40))


def test_a_model_that_cannot_be_loaded_leaves_the_old_one(spark, monkeypatch):
    e = scored_view(spark, SF)
    r = Registry(spark, folder(spark, "registry"))
    t0 = dt.datetime(2024, 1, 31, tzinfo=dt.UTC)
    version = retrain.retrain(r, e, t0, trees=5, at_least=10)
    scorer = scoring.Scorer(r, pause_s=0.0)
    batch = e.select("event_id", "source_id", "event_type", "event_time", "features", "feature_vector")
    used = lambda: {x.model_version for x in scorer.score(batch).select("model_version").distinct().collect()}
    assert used() == {version}
    r.activate("broken", t0 + dt.timedelta(hours=1))
    tries, load = [], r.load
    monkeypatch.setattr(r, "load", lambda *a: (tries.append(a), load(*a))[1])
    assert used() == {version} and len(tries) == 3
    assert used() == {version} and len(tries) == 3  # not tried again
    # Scores still come from the old trees, which were not released.
    assert scorer.score(batch).filter("anomaly_score is null").count() == 0
    r.activate("dummy-v0", t0 + dt.timedelta(hours=2))
    assert used() == {"dummy-v0"}
    r.activate(version, t0 + dt.timedelta(hours=3))
    assert used() == {version}
    with pytest.raises(LookupError):
        scoring.Scorer(Registry(spark, folder(spark, "none")), pause_s=0.0).model("nothing")


def test_offsets_of_topics_from_progress(spark):
    import json

    from tidewarden.plans import monitoring
    from tidewarden.streaming import progress

    def report(batch, ends, latest, n):
        source = {"description": "KafkaV2[Subscribe[raw]]", "endOffset": ends, "latestOffset": latest, "numInputRows": n}
        return {"id": "q", "runId": "r", "batchId": batch, "timestamp": f"2024-01-01T00:00:0{batch}Z", "numInputRows": n,
                "sources": [source], "observedMetrics": {"outcomes": {"success": n - 1, "error": 1}}}

    path = folder(spark, "progress")
    log = progress.ProgressLog(spark, path)
    log._write("progress", "0", json.dumps(report(0, {"raw": {"0": 5, "1": 7}}, {"raw": {"0": 9, "1": 9}}, 12)))
    log._write("progress", "1", json.dumps(report(1, {"raw": {"0": 8, "1": 9}}, {"raw": {"0": 12, "1": 9, "2": 4}}, 5)))
    rows = progress.progress_rows(spark, path)
    lag = {r.partition: r.lag for r in monitoring.partition_lag(monitoring.progress_offsets(rows)).collect()}
    assert lag == {0: 4, 1: 0}
    assert {r.status: r.events for r in monitoring.progress_counts(rows).collect()} == {"success": 15, "error": 2}
    assert {r.events for r in monitoring.progress_counts(rows.limit(0)).collect()} == {0}
