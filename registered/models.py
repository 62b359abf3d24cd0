"""Registered model, quality and monitoring queries, with SQL twins where SQL can say it."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from registered.alerts import LABELS_SQL, label_log
from registered.common import SCORED_SQL as S
from registered.common import scored, table
from registered.ingest import messages
from tidewarden.functions.quantiles import exact_percentile
from tidewarden.functions.timebuckets import latest_time
from tidewarden.operators import alerts, autoencoder, decode, drift, evaluate, forest, half_space
from tidewarden.plans import monitoring, queries, retrain
from tidewarden.session import shared_dir
from tidewarden.sources import registry

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


NEWEST = "(SELECT max(event_time) FROM scored)"


# --- isolation forest -------------------------------------------------------------


def vectors(s, sf):
    return table(s, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("event_id"), F.col("embedding").cast("array<double>").alias("x")
    )


def fitted(s, sf, trees=200, contamination=0.05):
    return forest.fit(vectors(s, sf), "x", "event_id", "v1", trees=trees, contamination=contamination)


register("m01_forest_fit", lambda s, sf: fitted(s, sf).to_df(s).filter("child <> node or path > 0"))


def forest_scores(s, sf):
    v = vectors(s, sf)
    return (
        v.withColumn("decision", forest.decide(fitted(s, sf), F.col("x")))
        .withColumn("anomaly_score", forest.normalised(F.col("decision")))
        .withColumn("is_anomaly", forest.raw_flag(F.col("decision")))
        .drop("x")
    )


register("m02_forest_score", forest_scores)


def two_trees(version="given"):
    """A written-down forest over (k, value), as SQL can walk it."""
    inf = float("inf")
    return forest.Forest(
        version, 4, 0.1, -0.5,
        np.array([[0, 1, 0, 0, 0], [1, 0, 0, 0, 0]]),
        np.array([[50.0, 20.0, inf, inf, inf], [60.0, 30.0, inf, inf, inf]]),
        np.array([[1, 3, 2, 3, 4], [1, 3, 2, 3, 4]]),
        np.array([[0, 0, 1.0, 2.0, 3.0], [0, 0, 1.5, 2.5, 2.0]]),
    )


def given_forest(s, sf):
    """Scores of two written-down trees over (k, value)."""
    model = two_trees()
    d = scored(s, sf).withColumn("decision", forest.decide(model, F.col("feature_vector")))
    return d.select(
        "event_id", F.round("decision", 9).alias("decision"), forest.raw_flag(F.col("decision")).alias("flag"),
        F.round(forest.normalised(F.col("decision")), 9).alias("score"),
    )


def tree_sql(source, k="k", value="value", columns="event_id"):
    """Tables p (depths) and d (decisions of the two trees) over ``source``."""
    return f"""p AS (SELECT *, (CASE WHEN {k} > 50 THEN 1.0 WHEN {value} > 20 THEN 3.0 ELSE 2.0 END::DOUBLE
        + CASE WHEN {value} > 60 THEN 1.5 WHEN {k} > 30 THEN 2.0 ELSE 2.5 END::DOUBLE) / 2 AS depth FROM {source}),
    d AS (SELECT *, -pow(2::DOUBLE, -depth / (2 * (ln(3::DOUBLE) + {forest.EULER}::DOUBLE) - 1.5::DOUBLE))
        + 0.5::DOUBLE AS decision FROM p)"""


register(
    "m02_given_forest",
    given_forest,
    f"""{S}, {tree_sql('scored')}
    SELECT event_id, round(decision, 9) AS decision, decision < 0 AS flag,
      round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE - decision)), 9) AS score FROM d""",
)


def decided(s, sf):
    """Events with a decision value derived from their score."""
    return scored(s, sf).withColumn("decision", F.lit(0.6) - F.col("features")["value"] / 150.0)


DECIDED = f"{S}, d AS (SELECT *, 0.6::DOUBLE - value / 150.0::DOUBLE AS decision FROM scored)"
NORMAL = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE - decision))"
register(
    "m03_score_normalise",
    lambda s, sf: decided(s, sf).select(
        "event_id", forest.normalised(F.col("decision")).alias("score"),
        forest.raw_flag(F.col("decision")).alias("raw_flag"),
    ),
    f"{DECIDED} SELECT event_id, {NORMAL} AS score, decision < 0 AS raw_flag FROM d",
)
register(
    "m04_thresholds",
    lambda s, sf: scored(s, sf).select(
        "event_id",
        forest.flag_raise(F.col("event_type") == "error", F.col("anomaly_score")).alias("worker"),
        forest.flag_at_least(F.col("anomaly_score")).alias("at_least"),
        forest.flag_above(F.col("anomaly_score")).alias("above"),
    ),
    f"""{S} SELECT event_id, event_type = 'error' OR anomaly_score >= 0.7::DOUBLE AS worker,
    anomaly_score >= 0.7::DOUBLE AS at_least, anomaly_score > 0.7::DOUBLE AS above FROM scored""",
)


def fallback_ranges(s, sf):
    e = scored(s, sf)
    out = {m: forest.fallback_score(F.col("event_id"), m) for m in forest.FALLBACK_RANGES}
    return e.agg(
        F.count("*").alias("events"),
        F.count_if(out["worker"].between(0.05, 0.35)).alias("worker"),
        F.count_if(out["engine"].between(0.0, 1.0)).alias("engine"),
        F.count_if(out["error"] == 0.0).alias("error"),
        (F.abs(F.avg(out["engine"]) - 0.5) < 0.05).alias("centred"),
    )


register(
    "m05_fallback_scores",
    fallback_ranges,
    "SELECT count(*) AS events, count(*) AS worker, count(*) AS engine, count(*) AS error, true AS centred FROM events",
)
register(
    "m06_scored_records",
    lambda s, sf: forest.from_decision(decided(s, sf), "decision", "v9", processed_at=F.col("processed_at")).drop(
        "features", "feature_vector"
    ),
    f"""{DECIDED}, n AS (SELECT *, {NORMAL} AS sc FROM d)
    SELECT event_id, source_id, event_type, event_time, sc AS anomaly_score, decision < 0 OR sc >= 0.7::DOUBLE AS is_anomaly,
      CASE WHEN NOT (decision < 0 OR sc >= 0.7::DOUBLE) THEN 'LOW' WHEN sc >= 0.9::DOUBLE THEN 'CRITICAL'
        WHEN sc >= 0.75::DOUBLE THEN 'HIGH' WHEN sc >= 0.5::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS severity,
      'v9' AS model_version, processed_at, event_date FROM n""",
)


def evaluation(s, sf):
    e = scored(s, sf).withColumn("label", F.col("event_type").isin("error", "view").cast("int"))
    auc = evaluate.roc_auc(e, "anomaly_score", "label")
    return rounded(
        evaluate.classification(e, "is_anomaly", "label").withColumn("roc_auc", F.lit(auc)),
        "precision", "recall", "f1", "roc_auc",
    )


register(
    "m07_evaluation",
    evaluation,
    f"""{S}, e AS (SELECT is_anomaly AS f, event_type IN ('error', 'view') AS y, anomaly_score AS s FROM scored),
    r AS (SELECT y, (min(i) OVER (PARTITION BY s) + max(i) OVER (PARTITION BY s)) / 2.0::DOUBLE AS rk
      FROM (SELECT y, s, row_number() OVER (ORDER BY s) AS i FROM e)),
    a AS (SELECT sum(rk) FILTER (WHERE y) AS rs, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM r),
    c AS (SELECT count(*) FILTER (WHERE f AND y) AS tp, count(*) FILTER (WHERE f AND NOT y) AS fp,
      count(*) FILTER (WHERE NOT f AND y) AS fn FROM e)
    SELECT round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
      round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
      round((rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n), 9) AS roc_auc FROM c, a""",
)
register(
    "m08_fit_summary",
    lambda s, sf: rounded(
        evaluate.fit_summary(decided(s, sf)), "anomaly_rate", "mean_decision_score", "std_decision_score"
    ),
    f"""{DECIDED} SELECT round(avg(CASE WHEN decision < 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS anomaly_rate,
      round(avg(decision), 9) AS mean_decision_score, round(stddev_pop(decision), 9) AS std_decision_score FROM d""",
)


def run_log(s, sf):
    """One logged run per model version with its rate; then the log as a table."""
    r = registry.Registry(s, shared_dir(s, "runs"))
    e = decided(s, sf)
    rows = e.groupBy("model_version").agg(
        F.avg((F.col("decision") < 0).cast("double")).alias("rate"), F.min("event_time").alias("at")
    )
    for row in rows.collect():  # one row per model version
        r.log_run(row.model_version, "IsolationForest", {"n_estimators": 200}, {"anomaly_rate": row.rate},
                  row["at"].replace(tzinfo=dt.UTC))
    return r.runs().select(
        "version", "model_type", F.col("parameters")["n_estimators"].alias("n_estimators"),
        F.round(F.col("metrics")["anomaly_rate"], 9).alias("anomaly_rate"),
    )


register(
    "m09_run_log",
    run_log,
    f"""{DECIDED} SELECT model_version AS version, 'IsolationForest' AS model_type, '200' AS n_estimators,
      round(avg(CASE WHEN decision < 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS anomaly_rate FROM d GROUP BY 1""",
)


FOLD = "(('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 5)::INTEGER"
register("m10_contamination_sweep", lambda s, sf: forest.sweep(vectors(s, sf), "x", fitted(s, sf, 100, 0.1)))
register(
    "m10_given_sweep",
    lambda s, sf: rounded(forest.sweep(scored(s, sf), "feature_vector", two_trees()), "offset"),
    f"""{S}, {tree_sql('scored')}, o AS ({' UNION ALL '.join(
        f"SELECT {c}::DOUBLE AS c, quantile_cont(decision - 0.5::DOUBLE, {c}) AS edge, count(*) AS rows FROM d"
        for c in (0.05, 0.1, 0.15))})
    SELECT c AS contamination, round(edge, 9) AS "offset", (SELECT count(*) FROM d WHERE decision - 0.5::DOUBLE < edge) AS flagged,
      rows FROM o""",
)
register(
    "m10_cross_validation",
    lambda s, sf: forest.cross_validate(vectors(s, sf), "x", "event_id", trees=100, contamination=0.1),
)
register(
    "m10_folds",
    lambda s, sf: vectors(s, sf).groupBy(forest.fold_of(F.col("event_id")).alias("fold")).agg(F.count("*").alias("rows")),
    f"SELECT {FOLD} AS fold, count(*) AS rows FROM embeddings GROUP BY 1",
)

# --- autoencoder --------------------------------------------------------------------


def trained(s, sf):
    return autoencoder.fit(vectors(s, sf), "x", "event_id", 64)


def training_curve(s, sf):
    return curve(s, trained(s, sf))


def curve(s, m):
    rows = [(i + 1, loss, m.threshold) for i, loss in enumerate(m.losses)]
    return s.createDataFrame(rows, "epoch int, loss double, threshold double")


register("m11_autoencoder_fit", training_curve)
register(
    "m11_autoencoder_summed_fit",
    lambda s, sf: curve(s, autoencoder.fit(vectors(s, sf), "x", "event_id", 64, epochs=8, steps=5)),
)
register("m12_autoencoder_score", lambda s, sf: autoencoder.score(vectors(s, sf), trained(s, sf), "x").drop("x"))


def given_network(s, sf):
    """Errors of a written-down 2-1-2 network."""
    weights = np.array([0.5, -0.25, 1.0, 0.1, 0.2, -1.0, 2.0])
    m = autoencoder.Autoencoder("given", [2, 1, 2], weights, 400.0)
    return rounded(
        autoencoder.score(scored(s, sf).select("event_id", F.col("feature_vector").alias("x")), m, "x").drop("x"), "score"
    )


register(
    "m12_given_network",
    given_network,
    f"""{S}, h AS (SELECT event_id, k, value, greatest(0, 0.5::DOUBLE * k - 0.25::DOUBLE * value + 1) AS h FROM scored),
    e AS (SELECT event_id, (pow(0.1::DOUBLE * h - 1 - k, 2) + pow(0.2::DOUBLE * h + 2 - value, 2)) / 2 AS e FROM h)
    SELECT event_id, round(e, 9) AS score, e > 400 AS is_anomaly FROM e""",
)


def thresholds(s, sf):
    e = scored(s, sf).withColumn("error", F.col("features")["value"])
    p95 = exact_percentile(e, "error", 0.95, keep=500)
    return rounded(evaluate.error_thresholds(e, "error").withColumn("p95", F.lit(p95)), "threshold", "p95")


register(
    "m13_error_thresholds",
    thresholds,
    f"""{S} SELECT round(avg(value) + 3 * stddev_pop(value), 9) AS threshold, round(quantile_cont(value, 0.95), 9) AS p95
    FROM scored""",
)

# --- online models -------------------------------------------------------------------

register(
    "m14_half_space_trees",
    lambda s, sf: half_space.batch_scores(scored(s, sf), "event_type", "feature_vector", 2),
)
# Two written-down trees of height 2 over (k, value): feature and cut of the nodes 0, 1, 2.
GIVEN_TREES = (np.array([[0, 1, 1], [1, 0, 1]]), np.array([[0.1, -0.2, 0.3], [0.0, 0.5, 1.0]]))


def half_space_sql():
    """Scores of the given trees: scaler sums and masses as windows over each key's rows."""
    before, upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS UNBOUNDED PRECEDING"

    def z(v, n):
        var = f"({v}2 / {n} - ({v}1 / {n}) * ({v}1 / {n}))"
        return f"CASE WHEN {n} > 0 AND {var} > 0 THEN (d{v[1:]} - {v}1 / {n}) / sqrt({var}) ELSE 0 END"

    names, sums, places = ("k", "value"), [], []
    for f, name in enumerate(names):
        for p, frame in (("b", before), ("a", upto)):
            for power in (1, 2):
                term = " * ".join([f"d{f}"] * power)
                sums.append(f"coalesce(sum({term}) OVER (PARTITION BY event_type ORDER BY ms, event_id {frame}), 0) AS {p}{f}{power}")
    for p in "ba":
        n = "pos" if p == "b" else "(pos + 1)"
        places += [f"{z(f'{p}{f}', n)} AS z{p}{f}" for f in range(2)]
    nodes = []
    for p in "ba":
        for t, (feature, cut) in enumerate(zip(*GIVEN_TREES)):
            side = lambda i: f"(z{p}{feature[i]} >= {cut[i]}::DOUBLE)::INTEGER"  # noqa: B023, E731
            nodes.append(f"1 + {side(0)} AS {p}{t}_1")
            nodes.append(f"CASE WHEN {side(0)} = 0 THEN 3 + {side(1)} ELSE 5 + {side(2)} END AS {p}{t}_2")
    mass = " UNION ALL ".join(
        f"SELECT event_type, slot, {t} AS t, {node} AS node, count(*) AS m FROM n GROUP BY 1, 2, 3, 4"
        for t in range(2) for node in ("0", f"a{t}_1", f"a{t}_2")
    )
    held = lambda t, node: (
        f"coalesce((SELECT m FROM mass WHERE mass.event_type = n.event_type AND mass.slot = n.slot - 1 AND t = {t} AND node = {node}), 0)"
    )
    terms = " + ".join(
        f"(SELECT m0 + CASE WHEN m0 >= 25 THEN 2 * m1 + CASE WHEN m1 >= 25 THEN 4 * m2 ELSE 0 END ELSE 0 END FROM "
        f"(SELECT {held(t, '0')} AS m0, {held(t, f'b{t}_1')} AS m1, {held(t, f'b{t}_2')} AS m2))"
        for t in range(2)
    )
    first = "OVER (PARTITION BY event_type ORDER BY ms, event_id)"
    return f"""{S}, c AS (SELECT event_type, event_id, ms, row_number() {first} - 1 AS pos, k - first_value(k) {first} AS d0,
        value - first_value(value) {first} AS d1 FROM scored),
    w AS (SELECT *, {', '.join(sums)} FROM c),
    q AS (SELECT *, pos // 250 AS slot, {', '.join(places)} FROM w),
    n AS (SELECT *, {', '.join(nodes)} FROM q),
    mass AS ({mass}),
    scores AS (SELECT event_type, event_id, pos, slot, ({terms})::DOUBLE AS m FROM n)
    SELECT event_type, event_id, pos AS position,
      round(CASE WHEN slot > 0 THEN 1 - m / (2 * 250 * 7)::DOUBLE ELSE 0 END, 9) AS score FROM scores"""


register(
    "m14_given_trees",
    lambda s, sf: rounded(
        half_space.batch_scores(
            scored(s, sf), "event_type", "feature_vector", 2, params=half_space.Params(trees=2, height=2), given=GIVEN_TREES
        ),
        "score",
    ),
    half_space_sql(),
)
PH = drift.Params(min_instances=100, delta=0.005, threshold=6.0)
register(
    "m15_page_hinkley",
    lambda s, sf: drift.batch_drifts(
        scored(s, sf), "model_version", "anomaly_score", params=PH, block_rows=2000
    ).select("model_version", "event_id", "position"),
    f"""{S.replace('WITH scored', 'WITH RECURSIVE scored')}, x AS (SELECT model_version AS m, event_id, anomaly_score AS v,
      row_number() OVER (PARTITION BY model_version ORDER BY ms, event_id) - 1 AS i FROM scored),
    w AS (
      SELECT m, -1::BIGINT AS i, 0::BIGINT AS n, 0.0::DOUBLE AS t, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d,
        'Infinity'::DOUBLE AS lo, '-Infinity'::DOUBLE AS hi, false AS hit FROM x GROUP BY m
      UNION ALL
      SELECT m, i, n, t, u, d, lo, hi, n >= 100 AND (u - lo > 6.0 OR hi - d > 6.0) FROM (
        SELECT m, i, n, t, u, d, least(lo0, u) AS lo, greatest(hi0, d) AS hi FROM (
          SELECT m, i, n, t, lo0, hi0, 0.9999::DOUBLE * u0 + v - t / n - 0.005::DOUBLE AS u,
            0.9999::DOUBLE * d0 + v - t / n + 0.005::DOUBLE AS d FROM (
            SELECT x.m, x.i, x.v, CASE WHEN hit THEN 1 ELSE n + 1 END AS n,
              CASE WHEN hit THEN v ELSE t + v END AS t, CASE WHEN hit THEN 0 ELSE u END AS u0,
              CASE WHEN hit THEN 0 ELSE d END AS d0, CASE WHEN hit THEN 'Infinity'::DOUBLE ELSE lo END AS lo0,
              CASE WHEN hit THEN '-Infinity'::DOUBLE ELSE hi END AS hi0
            FROM w JOIN x ON x.m = w.m AND x.i = w.i + 1))))
    SELECT x.m AS model_version, x.event_id, x.i AS position FROM w JOIN x ON x.m = w.m AND x.i = w.i WHERE hit""",
)


def psi_index(s, sf):
    e = scored(s, sf)
    half = F.col("event_date") < F.lit(dt.date(2024, 1, 16))
    shifted = F.when(F.col("event_type") == "error", F.least(F.lit(1.0), F.col("anomaly_score") * 2)).otherwise(
        F.col("anomaly_score")
    )
    inner = [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8]
    return rounded(
        evaluate.drift_gate(
            evaluate.psi(
                e.filter(half).select("anomaly_score"), e.filter(~half).select(shifted.alias("anomaly_score")),
                "anomaly_score", inner=inner,
            ),
            0.01,
        ),
        "psi",
    )


BIN = "len(list_filter([0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8], lambda b: b::DOUBLE <= v))"
register(
    "m16_psi_gate",
    psi_index,
    f"""{S}, b AS (
      SELECT {BIN} AS bin, count(*) FILTER (WHERE old)::DOUBLE AS o, count(*) FILTER (WHERE NOT old)::DOUBLE AS n FROM (
        SELECT event_date < DATE '2024-01-16' AS old, CASE WHEN event_date >= DATE '2024-01-16' AND event_type = 'error'
          THEN least(1.0::DOUBLE, anomaly_score * 2) ELSE anomaly_score END AS v FROM scored) GROUP BY 1),
    q AS (SELECT greatest(n / sum(n) OVER (), 1e-4) AS p, greatest(o / sum(o) OVER (), 1e-4) AS q FROM b)
    SELECT round(sum((p - q) * ln(p / q)), 9) AS psi, sum((p - q) * ln(p / q)) > 0.01 AS retrain FROM q""",
)



def psi_by_sketch(s, sf):
    """Gate of each model version on its stored baseline of the first half of the month."""
    e, store = scored(s, sf), registry.Registry(s, shared_dir(s, "baselines"))
    half, out = F.col("event_date") < F.lit(dt.date(2024, 1, 16)), None
    # Sketched by day, merged by version, as a daily job would do it.
    daily = evaluate.share_sketch(e.filter(half).withColumn("part", F.concat("model_version", "event_date")), "anomaly_score", "part")
    parts = daily.select(F.substring("part", 1, 6).alias("model_version"), "cell", "n")
    sketches = evaluate.merge_sketches(parts)
    for version in ("v1.0.0", "v1.1.0", "v2.0.0"):
        store.save("baseline", version, sketches.filter(F.col("model_version") == version).select("cell", "n"))
        now = e.filter(~half & (F.col("model_version") == version)).withColumn("anomaly_score", F.sqrt("anomaly_score"))
        one = evaluate.psi_of_sketch(store.load("baseline", version).select("cell", "n"), now, "anomaly_score")
        one = rounded(evaluate.drift_gate(one), "psi").withColumn("model_version", F.lit(version))
        out = one if out is None else out.unionByName(one)
    return out


register(
    "m16_psi_by_sketch",
    psi_by_sketch,
    f"""{S}, c AS (SELECT model_version AS m, event_date < DATE '2024-01-16' AS old, floor((CASE WHEN event_date < DATE '2024-01-16'
        THEN anomaly_score ELSE sqrt(anomaly_score) END) / 1e-4::DOUBLE)::BIGINT AS cell FROM scored),
    u AS (SELECT m, cell, sum(count(*)) OVER (PARTITION BY m ORDER BY cell) AS upto, sum(count(*)) OVER (PARTITION BY m) AS total
      FROM c WHERE old GROUP BY m, cell),
    x AS (SELECT DISTINCT m, min(cell) + 1 AS edge FROM u, range(1, 10) r(i) WHERE upto * 10 >= total * i GROUP BY m, i),
    b AS (SELECT m, bin, count(*) FILTER (WHERE old)::DOUBLE AS o, count(*) FILTER (WHERE NOT old)::DOUBLE AS n FROM (
      SELECT c.m, old, (SELECT count(*) FROM x WHERE x.m = c.m AND edge <= cell) AS bin FROM c) GROUP BY m, bin),
    q AS (SELECT m, greatest(n / sum(n) OVER (PARTITION BY m), 1e-4) AS p, greatest(o / sum(o) OVER (PARTITION BY m), 1e-4) AS q FROM b)
    SELECT m AS model_version, round(sum((p - q) * ln(p / q)), 9) AS psi, sum((p - q) * ln(p / q)) > 0.25 AS retrain FROM q GROUP BY m""",
)

# --- retraining ----------------------------------------------------------------------

register(
    "m17_training_set",
    lambda s, sf: retrain.training_set(scored(s, sf), at_least=100).select("event_id", "event_time"),
    f"""{S} SELECT event_id, event_time FROM scored WHERE event_time > {NEWEST} - INTERVAL 30 DAY
    ORDER BY event_time DESC, event_id LIMIT 100000""",
)
register(
    "m18_recent_count",
    lambda s, sf: retrain.recent_count(scored(s, sf), days=10),
    f"{S} SELECT count(*) AS events FROM scored WHERE event_time > {NEWEST} - INTERVAL 10 DAY",
)


def accepted_labels(s, sf):
    return alerts.apply_labels(label_log(s, sf), scored(s, sf))[0]


QUALITY = """count(*) FILTER (WHERE label = 'TP')::DOUBLE AS tp, count(*) FILTER (WHERE label = 'FP') AS fp,
  count(*) FILTER (WHERE label = 'TN') AS tn, count(*) FILTER (WHERE label = 'FN') AS fn"""
RATIOS = """round(coalesce(tp / nullif(tp + fp, 0), 0.0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 9) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1,
  round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0.0), 9) AS accuracy"""
JOINED = f"""{LABELS_SQL}, j AS (SELECT s.model_version, l.label, l.labeled_at, CAST(l.labeled_at AS DATE) AS label_date
  FROM labels_log l JOIN scored s USING (event_id) WHERE label <> '??')"""


def daily_runs(s, sf):
    """Every (version, day) of label quality as one training run, newest last."""
    q = evaluate.model_quality(accepted_labels(s, sf), scored(s, sf), by_day=True)
    return q.select(
        F.col("model_version").alias("model_type"),
        F.col("label_date").cast("string").alias("version"),
        F.create_map(F.lit("f1"), F.round("f1", 9)).alias("metrics"),
        F.col("label_date").cast("timestamp").alias("started_at"),
    )


register(
    "m19_promotion_gate",
    lambda s, sf: registry.promotion_decisions(daily_runs(s, sf), "f1"),
    f"""{JOINED}, q AS (SELECT model_version, label_date, {QUALITY} FROM j GROUP BY 1, 2),
    r AS (SELECT model_version AS model_type, CAST(label_date AS VARCHAR) AS version, {RATIOS} FROM q),
    g AS (SELECT model_type, version, f1 AS new_metric, max(f1) OVER (PARTITION BY model_type ORDER BY version
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_metric FROM r)
    SELECT *, old_metric IS NULL OR new_metric >= old_metric AS deploy FROM g""",
)


def swap_and_rollback(s, sf):
    """Retrain twice on the events, then roll back; the pointer log is the result."""
    e = scored(s, sf)
    r = registry.Registry(s, shared_dir(s, "retrain"))
    newest = latest_time(e)
    versions = [
        retrain.retrain(r, e, newest - dt.timedelta(days=back), names=["k", "value"], skewed=["value"], at_least=100)
        for back in (5, 0)
    ]
    r.rollback(versions[0], newest + dt.timedelta(hours=1), "trial", "forest")
    return r.history().withColumn("active_now", F.lit(r.active()))


STAMP = "strftime(date_trunc('second', t - INTERVAL {0} DAY), '%Y%m%d_%H%M%S')"
register(
    "m20_retrain_swap_rollback",
    swap_and_rollback,
    f"""{S}, t AS (SELECT max(event_time) AS t FROM scored)
    SELECT {STAMP.format(5)} AS version, 'reload' AS action, '' AS reason, t - INTERVAL 5 DAY AS event_time,
      {STAMP.format(5)} AS active_now FROM t
    UNION ALL SELECT {STAMP.format(0)}, 'reload', '', t, {STAMP.format(5)} FROM t
    UNION ALL SELECT {STAMP.format(5)}, 'rollback', 'trial', t + INTERVAL 1 HOUR, {STAMP.format(5)} FROM t""",
)


def judged_retraining(s, sf):
    """Retraining with labels and one infinite value: the scaler that is stored, and the run's metrics."""
    e = scored(s, sf).withColumn(
        "features",
        F.when(F.col("event_id") == "7", F.create_map(F.lit("k"), F.lit(float("inf")), F.lit("value"), F.col("features")["value"]))
        .otherwise(F.col("features")),
    )
    r = registry.Registry(s, shared_dir(s, "retrain"))
    labels = e.select("event_id", (F.col("event_type") == "error").cast("int").alias("label"))
    version = retrain.retrain(r, e, names=["k", "value"], skewed=["value"], labels=labels, at_least=100)
    run = r.runs().filter(F.col("version") == version).first()
    ok = 0 <= run.metrics["f1"] <= 1 and 0 <= run.metrics["roc_auc"] <= 1 and r.active() == version
    return rounded(r.load("scaler", version).withColumn("run_ok", F.lit(ok)), "mean", "scale")


register(
    "m20_retrain_scaler",
    judged_retraining,
    f"""{S}, n AS (SELECT * FROM scored WHERE event_time > {NEWEST} - INTERVAL 30 DAY
      ORDER BY event_time DESC, event_id LIMIT 100000),
    v AS (SELECT 0 AS position, 'k' AS name, CASE WHEN event_id = '7' THEN NULL ELSE k END AS x FROM n
      UNION ALL SELECT 1, 'value', ln(1 + greatest(value, 0)) FROM n)
    SELECT strftime(date_trunc('second', {NEWEST}), '%Y%m%d_%H%M%S') AS version, position, name,
      round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS scale, name = 'value' AS skewed, true AS run_ok
    FROM v GROUP BY position, name""",
)
register(
    "m21_model_quality",
    lambda s, sf: rounded(
        evaluate.model_quality(accepted_labels(s, sf), scored(s, sf)), "precision", "recall", "f1", "accuracy"
    ),
    f"""{JOINED}, q AS (SELECT model_version, max(labeled_at) AS evaluation_date, {QUALITY} FROM j GROUP BY 1)
    SELECT model_version, evaluation_date, {RATIOS} FROM q""",
)
register(
    "m21_model_versions",
    lambda s, sf: evaluate.model_versions(
        scored(s, sf),
        rounded(evaluate.model_quality(accepted_labels(s, sf), scored(s, sf)), "f1", "accuracy").select(
            "model_version", "f1", "accuracy"
        ),
    ),
    f"""{JOINED}, q AS (SELECT model_version, {QUALITY} FROM j GROUP BY 1), r AS (SELECT model_version, {RATIOS} FROM q),
    v AS (SELECT model_version, min(event_time) AS registered_at FROM scored GROUP BY 1)
    SELECT model_version, registered_at, f1, accuracy, model_version = (SELECT model_version FROM scored
      ORDER BY event_time DESC, event_id DESC LIMIT 1) AS active FROM v LEFT JOIN r USING (model_version)""",
)
register(
    "q21_quality_by_day",
    lambda s, sf: rounded(
        evaluate.model_quality(accepted_labels(s, sf), scored(s, sf), by_day=True), "precision", "recall", "f1", "accuracy"
    ),
    f"""{JOINED}, q AS (SELECT model_version, label_date, max(labeled_at) AS evaluation_date, {QUALITY} FROM j GROUP BY 1, 2)
    SELECT model_version, label_date, evaluation_date, {RATIOS} FROM q""",
)


def job_log(s, sf):
    """Retraining job log: events of a source and day are the steps of one job."""
    e = scored(s, sf)
    status = (
        F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "COMPLETED")
        .when(F.col("event_type") == "click", "RUNNING").otherwise("PENDING")
    )
    return e.select(
        F.concat_ws("/", "source_id", "event_date").alias("job_id"), status.alias("status"),
        F.concat(F.lit("because "), F.col("event_id")).alias("reason"), F.col("is_anomaly").alias("force"),
        F.col("event_time").alias("at"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), F.col("event_id"))).alias("error"),
    )


JOBS_SQL = f"""{S}, log AS (SELECT source_id || '/' || event_date AS job_id, CASE event_type WHEN 'error' THEN 'FAILED'
    WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'RUNNING' ELSE 'PENDING' END AS status,
    'because ' || event_id AS reason, is_anomaly AS force, event_time AS tm,
    CASE event_type WHEN 'error' THEN 'failed at ' || event_id END AS error FROM scored),
  jobs AS (SELECT job_id, last(status ORDER BY tm, status) AS status, first(reason ORDER BY tm, status) AS reason,
    first(force ORDER BY tm, status) AS force, min(tm) AS created_at,
    max(tm) FILTER (WHERE status IN ('COMPLETED', 'FAILED')) AS completed_at, last(error ORDER BY tm, status) AS error
  FROM log GROUP BY 1)"""
register("q22_job_states", lambda s, sf: retrain.job_states(job_log(s, sf)), f"{JOBS_SQL} SELECT * FROM jobs")
register(
    "q22_retrain_jobs",
    lambda s, sf: queries.retrain_jobs(retrain.job_states(job_log(s, sf))),
    f"{JOBS_SQL} SELECT * FROM jobs ORDER BY created_at DESC, job_id LIMIT 50",
)
register(
    "q22_retrain_job",
    lambda s, sf: queries.retrain_job(retrain.job_states(job_log(s, sf)), "7/2024-01-09"),
    f"{JOBS_SQL} SELECT * FROM jobs WHERE job_id = '7/2024-01-09'",
)

# --- monitoring ------------------------------------------------------------------------


def statuses(s, sf):
    d = decode.decode(messages(s, sf))
    return monitoring.status_counts(decode.normalise(d), decode.dead_letters(d))


register(
    "q30_status_counts",
    statuses,
    """SELECT 'success' AS status, count(*) FILTER (WHERE value < 230) AS events FROM events
    UNION ALL SELECT 'error', count(*) FILTER (WHERE value >= 235) FROM events""",
)
register(
    "q30_severity_counts",
    lambda s, sf: monitoring.severity_counts(scored(s, sf)),
    f"""{S} SELECT severity, count(event_id) AS anomalies FROM (VALUES ('LOW', -1.0, 0.5), ('MEDIUM', 0.5, 0.75),
      ('HIGH', 0.75, 0.9), ('CRITICAL', 0.9, 2.0)) t(severity, lo, hi)
    LEFT JOIN scored ON is_anomaly AND anomaly_score >= lo::DOUBLE AND anomaly_score < hi::DOUBLE GROUP BY 1""",
)
HISTOGRAM = f"""{S}, h AS (SELECT le, count(*) FILTER (WHERE lat <= le) AS count, sum(lat) AS latency_sum FROM (
    SELECT (epoch_us(processed_at) - epoch_us(event_time)) / 1e6::DOUBLE AS lat FROM scored),
    (SELECT unnest([0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 'Infinity'::DOUBLE]) AS le)
  GROUP BY 1)"""
register(
    "q31_latency_histogram",
    lambda s, sf: rounded(monitoring.latency_histogram(scored(s, sf)), "latency_sum", digits=6),
    f"{HISTOGRAM} SELECT le, count, round(latency_sum, 6) AS latency_sum FROM h",
)


def percentiles(s, sf):
    h = monitoring.latency_histogram(scored(s, sf))
    out = None
    for pct in (5.0, 50.0, 95.0):
        one = monitoring.histogram_percentile(h, pct).withColumn("pct", F.lit(pct))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "percentile")


register(
    "q32_histogram_percentile",
    percentiles,
    f"""{HISTOGRAM}, c AS (SELECT le, count, lag(le, 1, 0) OVER (ORDER BY le) AS low, lag(count, 1, 0) OVER (ORDER BY le) AS below,
      max(count) OVER () AS total FROM h), p AS (SELECT unnest([5.0, 50.0, 95.0])::DOUBLE AS pct)
    SELECT pct, (SELECT round(low + (total * pct / 100 - below) / (count - below) * (le - low), 9) FROM c
      WHERE count >= total * pct / 100 ORDER BY le LIMIT 1) AS percentile FROM p""",
)


def offsets(s, sf):
    """Offsets as if keyed by event id over 6 partitions, read up to 25 January."""
    e = table(s, sf, "events")
    read = F.count_if(F.col("ts") < F.lit(dt.datetime(2024, 1, 25)))
    return e.groupBy((F.col("event_id") % 6).cast("int").alias("partition")).agg(
        F.count("*").alias("high"), read.alias("read")
    ).select(
        F.lit("raw-events").alias("topic"), "partition",
        F.when(F.col("partition") == 5, F.lit(-1)).otherwise(F.col("read")).alias("committed"), "high",
    )


LAG_SQL = """WITH lag AS (SELECT 'raw-events' AS topic, CAST(event_id % 6 AS INTEGER) AS partition,
  CASE WHEN event_id % 6 = 5 THEN 0 ELSE count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') END AS lag
  FROM events GROUP BY event_id % 6)"""
register("q33_partition_lag", lambda s, sf: monitoring.partition_lag(offsets(s, sf)), f"{LAG_SQL} SELECT * FROM lag")
register(
    "q33_topic_lag",
    lambda s, sf: monitoring.topic_lag(offsets(s, sf)),
    f"{LAG_SQL} SELECT topic, CAST(sum(lag) AS BIGINT) AS lag FROM lag GROUP BY 1",
)


def produced_and_received(s, sf):
    """Everything was produced; some ids are lost, some come twice, some are unknown."""
    e = table(s, sf, "events").select("event_id", "event_type", "value")
    seen = e.filter(F.col("value") < 300).select("event_id")
    again = e.filter((F.col("event_type") == "view") & (F.col("value") < 10)).select("event_id")
    foreign = e.filter(F.col("value") >= 400).select((-F.col("event_id") - 1).alias("event_id"))
    return e, seen.unionByName(again).unionByName(foreign)


register(
    "q34_id_balance",
    lambda s, sf: monitoring.id_balance(*produced_and_received(s, sf)).filter("problem is not null"),
    """SELECT event_id AS id, 1::BIGINT AS produced, 0::BIGINT AS received, 'lost' AS problem FROM events WHERE value >= 300
    UNION ALL SELECT event_id, 1, 2, 'duplicate' FROM events WHERE event_type = 'view' AND value < 10
    UNION ALL SELECT -event_id - 1, 0, 1, 'unexpected' FROM events WHERE value >= 400""",
)
register(
    "q34_completeness",
    lambda s, sf: monitoring.completeness(*produced_and_received(s, sf)),
    """SELECT count(*) AS produced, count(*) FILTER (WHERE value < 300) + count(*) FILTER (WHERE value >= 400) AS received,
      count(*) FILTER (WHERE value >= 300) AS lost, count(*) FILTER (WHERE event_type = 'view' AND value < 10) AS duplicate,
      count(*) FILTER (WHERE value >= 400) AS unexpected, false AS complete FROM events""",
)
register(
    "q35_throughput_report",
    lambda s, sf: rounded(monitoring.throughput_report(scored(s, sf)), "elapsed_s", "first_result_ms", digits=4),
    f"""{S}, t AS (SELECT count(*) AS received, (epoch_us(max(processed_at)) - epoch_us(min(event_time))) / 1e6::DOUBLE AS el,
      count(*) FILTER (WHERE is_anomaly) AS anomalies,
      (epoch_us(min(processed_at)) - epoch_us(min(event_time))) / 1e3::DOUBLE AS first_result FROM scored)
    SELECT received, round(el, 4) AS elapsed_s, anomalies, round(first_result, 4) AS first_result_ms,
      round(received / el, 1) AS events_per_s FROM t""",
)


def topic_rows(s, sf):
    return table(s, sf, "events").select(
        F.col("event_type").alias("topic"), F.col("ts").cast("timestamp").alias("event_time"),
        F.col("props").alias("value"), (F.col("value") >= 150).alias("failed"),
    )


register(
    "q36_topic_metrics",
    lambda s, sf: rounded(monitoring.topic_metrics(topic_rows(s, sf)), "messages_per_sec", "bytes_per_sec", "error_rate"),
    """SELECT event_type AS topic, time_bucket(INTERVAL '1 hour', ts) AS window_start, round(count(*) / 3600.0::DOUBLE, 9)
      AS messages_per_sec, round(sum(strlen(props)) / 3600.0::DOUBLE, 9) AS bytes_per_sec,
      round(avg(CASE WHEN value >= 150 THEN 1.0::DOUBLE ELSE 0 END), 9) AS error_rate FROM events GROUP BY 1, 2""",
)
