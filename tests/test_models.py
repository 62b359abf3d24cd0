"""Models: invariants, seeds, and equality with plain loops."""

import datetime as dt

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.functions.quantiles import exact_percentile, running_total
from tidewarden.operators import autoencoder, drift, evaluate, features, forest, half_space
from tidewarden.plans import monitoring, queries, retrain
from tidewarden.sources import synthetic


@pytest.fixture(scope="module")
def data(spark):
    df = synthetic.training_data(spark, 4000).persist()
    df.count()
    return df


def test_forest_invariants(spark, data):
    model = forest.fit(data, "vector", "id", trees=60, contamination=0.1)
    scored = data.withColumn("d", forest.decide(model, F.col("vector"))).withColumn(
        "score", forest.normalised(F.col("d"))
    )
    share = scored.agg(F.avg((F.col("d") < 0).cast("double"))).first()[0]
    assert share == pytest.approx(0.1, abs=0.01)
    assert scored.filter("score not between 0 and 1").count() == 0
    assert scored.filter("(d < 0) <> (score > 0.5)").count() == 0
    assert evaluate.roc_auc(scored, "score", "label") > 0.95
    raw = scored.agg(F.min(F.col("d") + model.offset), F.max(F.col("d") + model.offset)).first()
    assert -1 <= raw[0] < raw[1] < 0


def test_forest_is_fixed_by_its_seed(spark, data):
    a = forest.fit(data, "vector", "id", trees=20, seed=3)
    b = forest.fit(data.repartition(7), "vector", "id", trees=20, seed=3)
    c = forest.fit(data, "vector", "id", trees=20, seed=4)
    assert np.array_equal(a.threshold, b.threshold) and a.offset == b.offset
    assert not np.array_equal(a.threshold, c.threshold)
    back = forest.Forest.from_df(a.to_df(spark), a.version)
    x = np.vstack([r.vector for r in data.limit(50).collect()])
    assert np.allclose(back.decision(x), a.decision(x))


def test_forest_samples(spark):
    """Both ways of drawing give every tree enough rows and never all of one key."""
    df = spark.range(40_000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    for n, trees in ((40_000, 10), (40_000, 100)):
        per_tree = forest.tree_samples(df, "v", "id", trees, 256, n, 1).groupBy("tree").count()
        low, high, rows = per_tree.agg(F.min("count"), F.max("count"), F.count("*")).first()
        assert rows == trees and low >= 256 and high < 600
    small = forest.fit(df.limit(20), "v", "id", trees=5)
    assert small.sample_size == 20


def test_path_length():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert forest.average_path(256) == pytest.approx(10.2447, abs=1e-3)


def test_thresholds(spark):
    df = spark.createDataFrame([(0.7, False), (0.71, False), (0.1, True)], "s double, raw boolean")
    rows = df.select(
        forest.flag_raise(F.col("raw"), F.col("s")), forest.flag_at_least(F.col("s")), forest.flag_above(F.col("s"))
    ).collect()
    assert [tuple(r) for r in rows] == [(True, True, False), (True, True, True), (True, False, False)]


def test_exact_percentile(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=5000), rng.integers(0, 4, 3000).astype(float), np.zeros(500)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for q in (0.0, 0.05, 0.5, 0.95, 1.0):
            assert exact_percentile(df, "x", q, keep=200) == pytest.approx(np.percentile(values, 100 * q))
    assert exact_percentile(df.limit(0), "x", 0.5) is None


def test_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"), F.lit(2).alias("v"))
    out = running_total(df, "o", "v", "before", 16)
    assert out.filter("before <> o * 2").count() == 0 and out.count() == 1000


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, y int")
    assert evaluate.roc_auc(df, "s", "y") == pytest.approx(0.875)
    assert evaluate.roc_auc(df.filter("y = 1"), "s", "y") == 0.0
    none = evaluate.classification(df.withColumn("f", F.lit(False)), "f", "y").first()
    assert tuple(none) == (0.0, 0.0, 0.0)


def test_autoencoder(spark, data):
    normal = data.filter("label = 0")
    model = autoencoder.fit(normal, "vector", "id", 10, hidden=(32, 8, 32), epochs=10)
    assert model.losses[-1] < model.losses[0]
    err = autoencoder.score(normal, model, "vector")
    stats = err.agg(F.avg("score"), F.stddev_pop("score")).first()
    assert model.threshold == pytest.approx(stats[0] + 3 * stats[1])
    odd = autoencoder.score(data.filter("label = 1"), model, "vector")
    assert odd.agg(F.avg("score")).first()[0] > stats[0]
    back = autoencoder.Autoencoder.from_df(model.to_df(spark), model.version)
    x = np.vstack([r.vector for r in data.limit(20).collect()])
    assert np.allclose(
        autoencoder.errors(x, back.weights, back.sizes), autoencoder.errors(x, model.weights, model.sizes)
    )


def test_autoencoder_gradient():
    rng = np.random.default_rng(0)
    sizes = [3, 5, 2, 5, 3]
    w, x = autoencoder.initial(sizes, 1), rng.normal(size=(4, 3))
    g, _ = autoencoder.gradient(x, w, sizes)
    for i in rng.choice(len(w), 20, replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up = autoencoder.gradient(x, w + step, sizes)[1]
        down = autoencoder.gradient(x, w - step, sizes)[1]
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_autoencoder_parts_and_stop(spark, data, monkeypatch):
    monkeypatch.setattr(autoencoder, "MERGE", 4)
    model = autoencoder.fit(data, "vector", "id", 10, hidden=(16, 4, 16), epochs=3, threshold="p95", parts=9)
    err = np.array([r.score for r in autoencoder.score(data, model, "vector").collect()])
    assert model.threshold == pytest.approx(np.percentile(err, 95))
    stopped = autoencoder.fit(data, "vector", "id", 10, hidden=(4,), epochs=30, lr=0.0, patience=2)
    assert len(stopped.losses) < 10


def test_autoencoder_summed_gradients_do_not_depend_on_parts(spark, data, monkeypatch):
    monkeypatch.setattr(autoencoder, "MERGE", 4)
    kw = dict(hidden=(8, 3, 8), epochs=4, batch=64, steps=5)
    one, many = (autoencoder.fit(data, "vector", "id", 10, parts=p, **kw) for p in (1, 32))
    assert np.allclose(one.losses, many.losses, rtol=1e-9, atol=0)
    assert np.allclose(one.weights, many.weights, rtol=1e-6, atol=1e-9)
    assert one.losses[-1] < one.losses[0]
    # A plain loop over the same slices.
    rows = data.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(42))).select(
        F.pmod(F.xxhash64("h"), F.lit(5)).alias("slice"), "vector"
    ).collect()
    slices = [np.array([r.vector for r in rows if r.slice == i]) for i in range(5)]
    w = autoencoder.initial(one.sizes, 42)
    m, v, step, losses = np.zeros_like(w), np.zeros_like(w), 0, []
    for epoch in range(4):
        total = 0.0
        for i in np.random.default_rng([42, epoch]).permutation(5):
            g, loss = autoencoder.gradient(slices[i], w, one.sizes)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 1e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            total += loss * len(slices[i])
        losses.append(total / len(rows))
    assert np.allclose(losses, one.losses, rtol=1e-9, atol=0)


def test_autoencoder_without_rows(spark, data):
    for steps in (None, 3):
        with pytest.raises(ValueError, match="no rows"):
            autoencoder.fit(data.limit(0), "vector", "id", 10, hidden=(4,), steps=steps)


def test_half_space_scores_outliers():
    rng = np.random.default_rng(3)
    p = half_space.Params()
    trees = half_space.grow(5, p)
    warm = rng.normal(0, 0.5, (500, 5))
    state = half_space.State.start(warm[0], p)
    assert (half_space.fold(state, warm[:250], trees, p) == 0).all()
    half_space.fold(state, warm[250:], trees, p)
    normal = half_space.fold(state, rng.normal(0, 0.5, (30, 5)), trees, p)
    odd = half_space.fold(state, rng.normal(10, 1, (30, 5)), trees, p)
    assert odd.mean() > normal.mean()


def ordered(spark, values, key="m"):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(key, f"{i:06d}", t0 + dt.timedelta(seconds=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, event_id string, event_time timestamp, x double")


def test_page_hinkley_stable_and_shift():
    p = drift.Params(min_instances=50)
    s = drift.State()
    assert not any(drift.update(s, 0.3 + 0.01 * (i % 5), p) for i in range(200))
    p = drift.Params(min_instances=50, threshold=5)
    s = drift.State()
    assert any([drift.update(s, x, p) for x in [0.1] * 100 + [0.95] * 100])


def test_page_hinkley_batch_equals_loop(spark):
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.normal(m, 0.1, 700) for m in (0.2, 0.7, 0.1, 0.5)])
    p = drift.Params(min_instances=60, threshold=4.0)
    noise = rng.random(300)
    df = ordered(spark, hot).unionByName(ordered(spark, noise, "n"))
    got = {(r.k, r.position) for r in drift.batch_drifts(df, "k", "x", params=p, block_rows=97).collect()}
    want = set()
    for key, values in (("m", hot), ("n", noise)):
        s = drift.State()
        want |= {(key, i) for i, v in enumerate(values) if drift.update(s, float(v), p)}
    assert got == want and len(want) >= 4


def test_page_hinkley_rounds_do_not_go_with_its_blocks(spark, monkeypatch):
    """Signals in most of the 60 blocks: they are found in a few rounds, not block by block."""
    rng, p = np.random.default_rng(6), drift.Params(min_instances=20, threshold=2.0)
    x = np.concatenate([rng.normal(m, 0.2, 100) for m in [0.1, 0.8] * 15])
    rounds, search = [], drift._first_signals
    monkeypatch.setattr(drift, "_first_signals", lambda *a: rounds.append(1) or search(*a))
    got = sorted(r.position for r in drift.batch_drifts(ordered(spark, x), "k", "x", params=p, block_rows=50).collect())
    s = drift.State()
    want = [i for i, v in enumerate(x) if drift.update(s, float(v), p)]
    assert got == want and len({i // 50 for i in want}) > 20
    assert len(rounds) <= 3


def test_psi(spark):
    base = spark.range(5000).select((F.col("id") / 5000).alias("x"))
    same = evaluate.psi(base, base, "x").first()[0]
    moved = evaluate.drift_gate(evaluate.psi(base, base.select((F.col("x") * 0.5).alias("x")), "x")).first()
    assert same == pytest.approx(0, abs=1e-9) and moved.psi > 0.25 and moved.retrain


def test_newest_rows(spark, scored):
    got = {r.event_id for r in retrain.newest_rows(scored, 37).collect()}
    want = {r.event_id for r in scored.orderBy(F.desc("event_time"), "event_id").limit(37).collect()}
    assert got == want
    assert retrain.newest_rows(scored, 10**9).count() == scored.count()
    assert retrain.training_set(scored, at_least=10**6) is None


def test_rolling_features_equal_plain_loop(spark):
    rng = np.random.default_rng(2)
    ms = np.sort(rng.integers(0, 3_000_000, 800))
    values = 1e6 + rng.normal(size=800)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [("hot", f"{i:04d}", t0 + dt.timedelta(milliseconds=int(m)), float(v)) for i, (m, v) in enumerate(zip(ms, values))]
    df = spark.createDataFrame(rows, "source_id string, event_id string, event_time timestamp, v double")
    got = {r.event_id: r for r in features.with_rolling(df, "v", chunk_ms=400_000).collect()}
    back = {r.event_id: r for r in features.with_return(df, "v", chunk_ms=400_000).collect()}
    for i in range(800):
        inside = values[(ms <= ms[i]) & (ms >= ms[i] - 300_000)]
        r = got[f"{i:04d}"]
        assert r.rolling_mean_5m == pytest.approx(inside.mean(), rel=1e-12)
        assert r.rolling_std_5m == pytest.approx(inside.std(), abs=1e-6)
        past = np.flatnonzero((ms <= ms[i] - 60_000) & (ms >= ms[i] - 360_000))
        want = None if len(past) == 0 else values[i] / values[past[-1]] - 1
        assert back[f"{i:04d}"].price_return_1m == (None if want is None else pytest.approx(want, abs=1e-12))


def test_histogram_percentiles(spark):
    h = spark.createDataFrame([(1.0, 50), (2.0, 90), (float("inf"), 100)], "le double, count long")
    get = lambda p, **kw: monitoring.histogram_percentile(h, p, **kw).first()[0]
    assert get(25) == pytest.approx(0.5) and get(70) == pytest.approx(1.5)
    assert get(95) is None and get(95, overflow="top") == 2.0
    assert monitoring.histogram_percentile(h.withColumn("count", F.lit(0)), 50).first()[0] is None


def test_completeness(spark):
    ids = spark.range(200).select(F.col("id").alias("event_id"))
    assert monitoring.completeness(ids, ids).first().complete
    row = monitoring.completeness(ids, ids.filter("event_id > 0").unionByName(ids.limit(5))).first()
    assert not row.complete and row.lost + row.duplicate > 0


def test_query_bounds(scored):
    for kwargs in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            queries.list_events(scored, **kwargs)
    with pytest.raises(ValueError):
        queries.rolling_stats(scored, 0)
    empty = queries.window_stats(scored.limit(0)).first()
    assert (empty.total_events, empty.anomaly_count, empty.anomaly_rate_pct) == (0, 0, 0.0)


def test_paging_by_key_equals_paging_by_offset(scored):
    first = queries.list_events(scored, 20).collect()
    last = first[-1]
    after = (last.event_time.replace(tzinfo=dt.UTC), last.event_id)
    by_key = queries.list_events(scored, 20, after=after).collect()
    assert by_key == queries.list_events(scored, 20, offset=20).collect()


def test_window_stats_rate(spark):
    now = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    df = spark.range(500).select(
        F.lit(now).alias("event_time"), (F.col("id") < 25).alias("is_anomaly"), F.lit(0.5).alias("anomaly_score")
    )
    row = queries.window_stats(df).first()
    assert (row.total_events, row.anomaly_count, row.anomaly_rate_pct, row.window_minutes) == (500, 25, 5.0, 1440)


def test_alert_with_events(spark, scored):
    from tidewarden.operators import alerts

    built = alerts.build_alerts(scored)
    one = built.orderBy("alert_id").first()
    row = queries.alert_with_events(built, scored, one.alert_id).first()
    times = [e.event_time for e in row.linked_events]
    assert 1 <= len(times) <= 10 and times == sorted(times, reverse=True)
    assert queries.alert_with_events(built, scored, "none").count() == 0


def test_percentile_between_two_heavy_values(spark):
    values = [1.0] * 700 + [2.0] * 700 + [1.5] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for q in (0.0, 0.3, 0.499, 0.5, 0.501, 0.7, 1.0):
        assert exact_percentile(df, "x", q, keep=10) == pytest.approx(np.percentile(values, 100 * q))


@pytest.mark.parametrize("n", [300, 3000, 40_000])
def test_every_tree_takes_every_row_with_the_same_chance(spark, n):
    df = spark.range(n).select("id", F.array(F.rand(1)).alias("v"))
    drawn = forest.tree_samples(df, "v", "id", 40, 256, n, 3)
    chance = min(1.0, 384 / n)
    trees, rows, most = drawn.groupBy("id").agg(F.count("*").alias("k")).agg(F.sum("k"), F.count("*"), F.max("k")).first()
    assert trees == pytest.approx(40 * n * chance, rel=0.1) and most <= 40
    assert rows == pytest.approx(n * (1 - (1 - chance) ** 40), rel=0.05)
    assert drawn.distinct().count() == trees


def test_one_infinite_value_does_not_spoil_a_retraining(spark, scored, tmp_path):
    from tidewarden.operators import features
    from tidewarden.plans import retrain
    from tidewarden.sources.registry import Registry

    bad = scored.withColumn(
        "feature_vector",
        F.when(F.col("event_id") == "5", F.array(F.lit(float("inf")), F.lit(float("nan")))).otherwise(F.col("feature_vector")),
    )
    r = Registry(spark, str(tmp_path))
    version = retrain.retrain(r, bad, trees=5, at_least=100)
    s = features.Scaler.from_df(r.load("scaler", version), version)
    assert all(math.isfinite(x) and x > 0 for x in s.scale) and all(math.isfinite(x) for x in s.mean)
    assert s.names == ["f0", "f1"]
    z = bad.select(features.scaled_vector(F.create_map(F.lit("f1"), F.lit(float(s.mean[1]))), s).alias("z")).first().z
    assert z == [0.0, 0.0]  # a feature that is absent does not shift the others


def test_label_check_never_shuffles_the_events(spark, scored):
    from tidewarden.operators import alerts

    labels = spark.createDataFrame([("1", "TP"), ("1", "FP"), ("nobody", "TP"), ("2", "??")], "event_id string, label string")
    ok, rejected = alerts.apply_labels(labels, scored)
    assert sorted(r.label for r in ok.collect()) == ["FP", "TP"]
    assert {r.event_id for r in rejected.collect()} == {"nobody", "2"}


def test_newest_time_reads_the_last_day_only(spark, scored, tmp_path):
    from tidewarden.functions.timebuckets import latest_time

    path = str(tmp_path / "t")
    scored.select("event_id", "event_time", "event_date").write.partitionBy("event_date").parquet(path)
    table = spark.read.parquet(path)
    assert latest_time(table) == latest_time(scored.drop("event_date"))


def test_late_rows_in_burst_counts():
    from tidewarden.streaming.keyed import burst_counts

    held = np.array([1000, 2000])
    got = burst_counts(held, np.array([500, 61_500]), np.array([True, True]), 60_000)
    assert got.tolist() == [1, 2]
    assert burst_counts(held[:0], np.array([0, 0, 59_999, 60_000]), np.array([1, 1, 1, 1]), 60_000).tolist() == [1, 2, 3, 2]


def test_page_hinkley_looks_at_each_block_a_few_times(spark, monkeypatch):
    """Signals in every block: the rows that all rounds look at grow with the rows."""
    looked = []
    real = drift._first_signals

    def counted(live, *args):
        looked.append(live.count())
        return real(live, *args)

    monkeypatch.setattr(drift, "_first_signals", counted)
    p = drift.Params(min_instances=10, threshold=3.0)
    df = ordered(spark, [float(i // 100 % 2) for i in range(1200)])
    got = drift.batch_drifts(df, "k", "x", params=p, block_rows=200)
    assert got.count() >= 6 and len(looked) <= 8
    assert max(looked) <= drift.LOOK_AHEAD * 200 and sum(looked) <= 4 * 1200


def test_sketch_merges_and_gates_like_the_rows(spark):
    rng = np.random.default_rng(8)
    old, new = np.round(rng.beta(2, 5, 4000), 4), np.round(rng.beta(2.6, 5, 3000), 4)
    frame = lambda v: spark.createDataFrame([(float(x), i % 3) for i, x in enumerate(v)], "s double, part int")
    base, now = frame(old), frame(new)
    whole = evaluate.share_sketch(base, "s")
    parts = evaluate.merge_sketches(evaluate.share_sketch(base, "s", "part").drop("part"))
    assert whole.exceptAll(parts).count() == 0 and whole.count() == parts.count() <= 10_001
    edges = evaluate.sketch_edges(whole)
    upto = np.sort(np.floor(old / 1e-4))
    assert edges == sorted({int(upto[-(-4000 * i // 10) - 1]) + 1 for i in range(1, 10)})
    inner = [e * 1e-4 for e in edges]
    share = lambda v: np.maximum(np.bincount([sum(e <= c for e in edges) for c in np.floor(v / 1e-4)], minlength=10) / len(v), 1e-4)
    p, q = share(new), share(old)
    want = ((p - q) * np.log(p / q)).sum()
    assert evaluate.psi_of_sketch(whole, now, "s").first()[0] == pytest.approx(want) and want > 0.01
    assert evaluate.psi(base, now, "s", inner=inner).first()[0] == pytest.approx(want, rel=0.05)
    assert evaluate.psi_of_sketch(whole, base, "s").first()[0] == pytest.approx(0)
    assert evaluate.psi_of_sketch(whole.limit(0), now.limit(0), "s").first()[0] in (None, 0)


def test_queries_return_values_of_their_models(spark):
    """Tree shapes, score ranges and falling loss, on what the registered queries return."""
    import __spark_entry__ as entry

    sf, q = "/root/testdata/sf0.001", entry.queries()
    nodes = q["m01_forest_fit"](spark, sf).toPandas()
    for _, tree in nodes.groupby("tree"):
        leaf = tree["child"] == tree["node"]
        level = np.floor(np.log2(tree["node"] + 1))
        assert leaf.sum() == (~leaf).sum() + 1 and level.max() <= 8
        assert (tree["path"][leaf] >= level[leaf]).all() and (tree["child"][~leaf] == 2 * tree["node"][~leaf] + 1).all()
    scores = q["m02_forest_score"](spark, sf).toPandas()
    assert scores["anomaly_score"].between(0, 1).all() and scores["anomaly_score"].nunique() > 100
    assert np.allclose(scores["anomaly_score"], 0.5 - scores["decision"]) and (scores["is_anomaly"] == (scores["decision"] < 0)).all()
    sweep = q["m10_contamination_sweep"](spark, sf).toPandas()
    assert (sweep["flagged"] == np.ceil((sweep["rows"] - 1) * sweep["contamination"])).all() and sweep["offset"].between(-1, 0).all()
    folds = q["m10_cross_validation"](spark, sf).toPandas()
    assert folds["anomaly_rate"].between(0, 0.4).all() and (folds["mean_decision_score"] > 0).all()
    curve = q["m11_autoencoder_fit"](spark, sf).toPandas()
    assert len(curve) <= 50 and curve["loss"].min() < 0.9 * curve["loss"].iloc[0] and (curve["threshold"] > 0).all()
    half = q["m14_half_space_trees"](spark, sf).toPandas()
    assert half["score"].between(0, 1).all() and (half["score"][half["position"] < 250] == 0).all()


def test_half_space_queries_equal_the_loop(spark):
    import __spark_entry__ as entry
    from registered.common import scored as view

    sf, p = "/root/testdata/sf0.01", half_space.Params()
    got = entry.queries()["m14_half_space_trees"](spark, sf).filter("event_type = 'error'").toPandas().sort_values("position")
    rows = view(spark, sf).filter("event_type = 'error'").orderBy("event_time", "event_id").collect()
    x = np.array([r.feature_vector for r in sorted(rows, key=lambda r: (int(r.event_time.timestamp() * 1000), r.event_id))])
    want = half_space.fold(half_space.State.start(x[0], p), x, half_space.grow(2, p), p)
    assert len(x) > 500 and np.allclose(got["score"], want) and want.max() > 0


def test_the_driver_gets_one_state_of_all_parts(spark):
    from tidewarden.operators import autoencoder

    states = [np.arange(6.0) * i for i in range(1, 9)]
    rows = [(i, 10 * (i + 1), i, 0.5 * i, x.tobytes()) for i, x in enumerate(states)]
    met = autoencoder._meet(spark.createDataFrame(rows, autoencoder.PART), 8)
    assert len(met) == 1 and met["rows"][0] == 360 and met["steps"][0] == 7
    share = np.arange(1, 9) / 36
    assert np.allclose(np.frombuffer(met["state"][0]), sum(w * x for w, x in zip(share, states)))
    assert autoencoder._meet(spark.createDataFrame([], autoencoder.PART), 8).empty
