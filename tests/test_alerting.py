"""Alert rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewarden.functions import severity as sev
from tidewarden.operators import alerts, notify

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def events(spark, rows):
    """Rows of (event_id, source_id, ms, score)."""
    df = spark.createDataFrame(
        [(str(i), s, at(ms), float(x)) for i, s, ms, x in rows],
        "event_id string, source_id string, event_time timestamp, anomaly_score double",
    )
    return df.withColumn("is_anomaly", F.lit(True))


def counts(df):
    return {r.event_id: r.burst_count for r in df.collect()}


SEVERITY = [
    *[(s, 0, "NONE") for s in (0.0, 0.5, 0.694, 0.695, 0.699, 0.6999999)],
    *[(s, 0, "LOW") for s in (0.70, 0.75, 0.799, 0.799999)],
    *[(s, 0, "MEDIUM") for s in (0.80, 0.85, 0.899)],
    *[(s, 0, "HIGH") for s in (0.90, 0.92, 0.94, 0.949)],
    *[(s, 0, "CRITICAL") for s in (0.95, 0.975, 0.99, 1.0)],
    *[(s, b, "CRITICAL") for s, b in ((0.5, 10), (0.695, 10), (0.75, 12), (0.85, 15), (0.9, 10), (0.0, 1000))],
    (0.9, 9, "HIGH"),
    (0.70, 9, "LOW"),
]


def test_severity_table(spark):
    df = spark.createDataFrame(SEVERITY, "score double, burst int, want string")
    got = df.withColumn("got", sev.alert_severity(F.col("score"), F.col("burst")))
    assert got.filter("got <> want").collect() == []


def test_routing_and_sla(spark):
    df = spark.createDataFrame([(s,) for s in ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")], "s string")
    rows = df.select(
        "s", sev.is_actionable(F.col("s")).alias("a"), sev.channels(F.col("s")).alias("c"),
        sev.sla_seconds(F.col("s")).alias("sla"), sev.route(F.col("s")).alias("r"),
    ).collect()
    assert [(r.s, r.a, r.c, r.sla, r.r) for r in rows] == [
        ("NONE", False, [], 0, "escalate_node"),
        ("LOW", True, [], 5, "end"),
        ("MEDIUM", True, ["slack"], 10, "notify_node"),
        ("HIGH", True, ["slack", "email"], 30, "escalate_node"),
        ("CRITICAL", True, ["slack", "email", "pagerduty"], 60, "escalate_node"),
    ]


def test_threshold_overrides():
    t = sev.AlertThresholds.from_settings({"high": 0.5, "burst_limit": 3.0, "other": 1})
    assert (t.high, t.burst_limit, t.low) == (0.5, 3, 0.70)
    with pytest.raises(ValueError):
        sev.in_severity_range(F.lit(1.0), "SEVERE")


def test_burst_ties(spark):
    rows = [(1, "a", 0, 0.95), (2, "a", 0, 0.95), (3, "a", 59_999, 0.95), (4, "a", 60_000, 0.95),
            (5, "a", 60_001, 0.72), (6, "a", 60_001, 0.91)]
    for chunk in (60_000, 600_000):
        got = counts(alerts.burst_counts(events(spark, rows), chunk_ms=chunk))
        assert got == {"1": 1, "2": 2, "3": 3, "4": 2, "5": 2, "6": 3}


def test_burst_window_and_input_set(spark):
    rows = [(f"{i:02d}", "a", 1000 * i, 0.92) for i in range(12)]
    rows += [("20", "a", 60_000, 0.92), ("21", "a", 30_000, 0.81), ("30", "b", 5_000, 0.95)]
    got = counts(alerts.burst_counts(events(spark, rows)))
    assert got["11"] == 12 and got["20"] == 12  # the row at 0 ms has left
    assert got["21"] == 12 and got["30"] == 1
    built = alerts.build_alerts(events(spark, rows))
    by_id = {r.event_id: r.severity for r in built.collect()}
    assert by_id["08"] == "HIGH" and by_id["09"] == "CRITICAL" and by_id["21"] == "CRITICAL"
    # A silenced row is not counted.
    rule = spark.createDataFrame(
        [("s", "a", 1, "x", T0, at(500))],
        "silence_id string, scope string, duration_minutes int, reason string, "
        "created_at timestamp, ends_at timestamp",
    )
    built = alerts.build_alerts(events(spark, rows), rule)
    by_id = {r.event_id: r for r in built.collect()}
    assert "00" not in by_id and by_id["10"].burst_count == 10 and by_id["09"].severity == "HIGH"


def test_burst_override_reaches_below_low(spark):
    rows = [(f"{i:02d}", "a", 10 * i, 0.95) for i in range(10)] + [("99", "a", 500, 0.1)]
    built = alerts.build_alerts(events(spark, rows))
    assert {r.event_id: r.severity for r in built.collect()}["99"] == "CRITICAL"


def test_burst_one_hot_source_matches_replay(spark):
    """One source holds most rows; the chunked sweep equals a plain replay."""
    import random

    rnd = random.Random(7)
    rows = [
        (f"{i:05d}", "hot" if rnd.random() < 0.8 else f"s{i % 5}", rnd.randrange(0, 900_000), rnd.random())
        for i in range(4000)
    ]
    clears = [("hot", 200_000), ("hot", 200_500), ("s1", 400_000), ("hot", 600_000)]
    want, seen, last = {}, {}, {}
    log = sorted([(ms, 1, i, s, x) for i, s, ms, x in rows] + [(ms, 0, "", s, None) for s, ms in clears])
    for ms, kind, i, s, x in log:
        if kind == 0:
            seen[s] = []
            continue
        held = [t for t in seen.get(s, []) if t > ms - 60_000]
        if x >= 0.9:
            held.append(ms)
        seen[s] = held
        want[i] = len(held)
    c = spark.createDataFrame([(s, at(ms)) for s, ms in clears], "source_id string, cleared_at timestamp")
    got = counts(alerts.burst_counts(events(spark, rows), chunk_ms=60_000, clears=c))
    assert got == want


def silence(spark, rows):
    return alerts.silence_rows(
        spark.createDataFrame(
            [(s, m, "why", at(ms)) for s, m, ms in rows],
            "source_id string, duration_minutes int, reason string, created_at timestamp",
        )
    )


def test_interval_cells_cover_their_hours_once(spark):
    rows = [(a, a + n) for a in (-3, 0, 1, 7, 62, 63, 64, 472_222) for n in (1, 2, 3, 4, 5, 16, 17, 100, 1000, 4097)]
    df = spark.createDataFrame(rows, "a long, b long")
    for r in df.select("a", "b", alerts.interval_cells(F.col("a"), F.col("b")).alias("c")).collect():
        hours = sorted(h for c in r.c for h in range(c.cell * 4**c.level, (c.cell + 1) * 4**c.level))
        assert hours == list(range(r.a, r.b))


def test_a_ten_year_silence_takes_few_rows(spark):
    far = at(0) + dt.timedelta(days=3652, hours=5, minutes=3)
    rules = spark.createDataFrame(
        [("s", at(90_000), far), ("*", far, far + dt.timedelta(minutes=1)), ("u", at(0), at(1))],
        "scope string, created_at timestamp, ends_at timestamp",
    )
    n = {r.scope: r["count"] for r in alerts.silence_cells(rules).groupBy("scope").count().collect()}
    assert n["s"] < 50 and n["*"] <= 2 and n["u"] == 1
    hours = [0, 89_999, 90_000, 3_600_000, 10**9, 10**11, 3652 * 86_400_000 + 5 * 3_600_000 + 180_000 - 1]
    rows = [(f"{s}{i}", s, ms, 1.0) for s in "su" for i, ms in enumerate([*hours, hours[-1] + 1, hours[-1] + 60_001])]
    kept = {r.event_id for r in alerts.unsilenced(events(spark, rows), rules).collect()}
    want = {e for e, s, ms, _ in rows if not (s == "s" and 90_000 <= ms <= hours[-1])
            and not (hours[-1] < ms <= hours[-1] + 60_000) and not (s == "u" and ms < 1)}
    assert kept == want


def storm(spark, n=3000):
    """Two thirds of all events on one source within a second, half of those on one millisecond."""
    ms = F.when(F.col("id") % 3 == 0, F.col("id") * 977 % 400_000).when(F.col("id") % 3 == 1, F.lit(120_500)).otherwise(
        F.lit(120_000) + F.col("id") * 7919 % 1000
    )
    return spark.range(n).select(
        F.format_string("%05d", F.col("id") * 2741 % n).alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id") % 5)).otherwise(F.lit("hot")).alias("source_id"),
        F.timestamp_millis(F.lit(1_704_067_200_000) + ms).alias("event_time"),
        (F.col("id") * 31 % 101 / 100).alias("anomaly_score"),
    )


def test_a_storm_inside_one_chunk_is_spread_and_counted_alike(spark):
    e = storm(spark)
    want = counts(alerts.burst_counts(e, 0.5))
    assert counts(alerts.burst_counts(e, 0.5, storm=50)) == want and max(want.values()) > 800
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would merge so few rows
    try:
        got = alerts.burst_counts(e, 0.5, storm=50)
        part = got.withColumn("p", F.spark_partition_id()).filter("source_id = 'hot'").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(part) > 3 and max(r["count"] for r in part) < 1200


def test_features_of_a_storm_equal_those_of_one_task(spark):
    from tidewarden.operators import features

    e = storm(spark).withColumn("v", F.when(F.col("anomaly_score") < 0.97, F.col("anomaly_score") * 100))
    for build, names in (
        (features.with_rolling, ("rolling_mean_5m", "rolling_std_5m", "volume_z_score")),
        (features.with_return, ("price_return_1m",)),
    ):
        late = e.withColumn("event_time", F.col("event_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("event_id").cast("int") % 4))
        one = {r.event_id: [r[n] for n in names] for r in build(late, "v").collect()}
        many = {r.event_id: [r[n] for n in names] for r in build(late, "v", storm=50).collect()}
        assert one.keys() == many.keys()
        for k, values in one.items():
            assert many[k] == [None if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) for v in values]


def test_silences(spark):
    rules = silence(spark, [("a", 10, 0), ("a", 1, 120_000), (None, 1, 3_600_000), ("b", 0, 0)])
    assert rules.count() == 3  # shorter than a minute is refused
    eff = alerts.effective_silences(rules)
    rows = [(1, "a", 0, 0.9), (2, "a", 119_999, 0.9), (3, "a", 179_999, 0.9), (4, "a", 180_000, 0.9),
            (5, "b", 1000, 0.9), (6, "b", 3_600_000, 0.9), (7, "c", 3_659_999, 0.9), (8, "c", 3_660_000, 0.9)]
    kept = {r.event_id for r in alerts.unsilenced(events(spark, rows), eff).collect()}
    assert kept == {"4", "5", "8"}
    removed = spark.createDataFrame([("a", at(60_000))], "source_id string, removed_at timestamp")
    eff = alerts.effective_silences(rules, removed)
    kept = {r.event_id for r in alerts.unsilenced(events(spark, rows), eff).collect()}
    assert kept == {"2", "4", "5", "8"}
    assert alerts.silence_info(eff, "a", at(150_000)).count() == 1
    assert alerts.silence_info(eff, "a", at(90_000)).count() == 0
    assert [r.scope for r in alerts.active_silences(eff, at(3_600_000)).collect()] == ["*"]


def test_no_silence_is_planned_as_nested_loop(spark):
    eff = alerts.effective_silences(silence(spark, [("a", 10, 0), (None, 1, 0)]))
    df = alerts.unsilenced(events(spark, [(1, "a", 0, 0.9)]), eff)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lifecycle(spark):
    base = events(spark, [(1, "a", 0, 0.95), (2, "b", 0, 0.95), (3, "c", 0, 0.95), (4, "d", 0, 0.95)])
    built = alerts.build_alerts(base)
    ids = {r.event_id: r.alert_id for r in built.collect()}
    log = [
        (ids["1"], "ACKNOWLEDGE", "ann", "seen", at(10), 1),
        (ids["1"], "RESOLVE", "bob", "fixed", at(20), 2),
        (ids["1"], "ACKNOWLEDGE", "cy", "late", at(30), 3),
        (ids["2"], "RESOLVE", "bob", "noise", at(5), 4),
        (ids["3"], "ACKNOWLEDGE", "ann", "one", at(5), 5),
        (ids["3"], "ACKNOWLEDGE", "dan", "two", at(5), 6),
        ("nope", "RESOLVE", "ann", "x", at(5), 7),
    ]
    t = spark.createDataFrame(
        log, "alert_id string, action string, analyst_id string, text string, at timestamp, seq long"
    )
    got = {r.event_id: r for r in alerts.alert_states(built, t).collect()}
    assert [got[i].status for i in "1234"] == ["RESOLVED", "RESOLVED", "ACKNOWLEDGED", "ACTIVE"]
    assert (got["1"].analyst_id, got["1"].note, got["1"].resolution) == ("bob", "seen", "fixed")
    assert got["3"].note == "two" and got["2"].acknowledged_at is None
    bad = {r.seq: r.problem for r in alerts.rejected_transitions(built, t).collect()}
    assert bad == {3: "Cannot acknowledge a resolved alert.", 7: "Alert not found"}


def test_alert_ids_are_stable(spark):
    import uuid

    built = alerts.build_alerts(events(spark, [("abc", "a", 0, 0.95)]))
    assert built.first().alert_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc"))


def test_payloads(spark):
    import json

    built = alerts.build_alerts(events(spark, [("e1", "a", 0, 0.97), ("e2", 'q"uote', 0, 0.85)]))
    rows = notify.notifications(built, "a@x.org, b@x.org,", "key").collect()
    by = {(r.event_id, r.channel): json.loads(r.payload) for r in rows}
    assert set(by) == {("e1", "slack"), ("e1", "email"), ("e1", "pagerduty"), ("e2", "slack")}
    attachment = by["e1", "slack"]["attachments"][0]
    assert attachment["color"] == "#7b0000"
    assert [b["type"] for b in attachment["blocks"]] == ["section", "section", "actions"]
    assert len(attachment["blocks"][1]["fields"]) == 6
    assert attachment["blocks"][1]["fields"][3]["text"] == "*Burst Count*\n1 HIGH/min"
    mail = by["e1", "email"]
    assert mail["personalizations"] == [{"to": [{"email": "a@x.org"}, {"email": "b@x.org"}]}]
    assert [c["type"] for c in mail["content"]] == ["text/plain", "text/html"]
    page = by["e1", "pagerduty"]
    assert page["event_action"] == "trigger" and page["payload"]["severity"] == "critical"
    assert page["payload"]["timestamp"] == "2024-01-01T00:00:00+00:00"
    assert 'q"uote' in by["e2", "slack"]["attachments"][0]["blocks"][0]["text"]["text"]
    resolve = json.loads(built.select(notify.pager_resolve("key").alias("p")).first().p)
    assert resolve["event_action"] == "resolve"


def test_fixed_point_text_equals_python(spark):
    import random

    from tidewarden.functions.text import fixed

    rnd = random.Random(1)
    values = [i / 200_000 for i in range(0, 20_000, 3)] + [rnd.random() for _ in range(2000)]
    values += [0.5, 1.5, 2.5, 0.125, 0.375, -0.00015, 1.0, 0.0, 0.99995, 123.456]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = df.select("x", fixed(F.col("x"), 4).alias("a"), fixed(F.col("x"), 0).alias("b"),
                    fixed(F.col("x") * 100, 1).alias("c")).collect()
    for r in out:
        assert r.a == f"{r.x:.4f}" and r.c == f"{r.x * 100:.1f}"
        assert r.b == f"{r.x:.0f}".replace("-0", "-0")
