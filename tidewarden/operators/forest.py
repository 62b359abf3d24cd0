"""Isolation forest: trees grown in parallel, scoring in Arrow batches.

Liu, Ting and Zhou (2008): every tree sees a small random sample and splits it at
random; unusual rows end up near the root. The score of a row is
``2 ** (-E[path length] / c(sample size))``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.arrays import matrix
from tidewarden.functions.identity import hash_uniform
from tidewarden.functions.quantiles import exact_percentile
from tidewarden.schema import ANOMALY_THRESHOLD

HASH_RANGE = 1 << 31
NODE_SCHEMA = "tree int, node int, feature int, threshold double, child int, path double"
EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """All trees as arrays [tree, node]; ``child`` of a leaf is the leaf itself."""

    version: str
    sample_size: int
    contamination: float
    offset: float
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    path: np.ndarray

    def sent(self):
        """The node arrays on all executors, sent once as long as the model is the same."""
        context = SparkSession.active().sparkContext
        held = self.__dict__.get("_sent")
        if held is None or held[0] is not context or held[1] != self.offset:
            self.release()
            arrays = (self.feature, self.threshold, self.child, self.path)
            value = (self.version, self.sample_size, self.contamination, self.offset, *arrays)
            held = self.__dict__["_sent"] = (context, self.offset, context.broadcast(value))
        return held[2]

    def release(self) -> None:
        """Take the arrays off the executors; later use sends them again."""
        held = self.__dict__.pop("_sent", None)
        if held is not None and held[0] is SparkSession.active().sparkContext:
            held[2].unpersist()

    @property
    def depth(self) -> int:
        return max(1, math.ceil(math.log2(max(self.sample_size, 2))))

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        """Negated anomaly score, as low as -1 for outliers."""
        if len(x) and x.shape[1] <= self.feature.max():
            raise ValueError("vectors are shorter than those the forest was grown on")
        out = np.empty(len(x))
        for start in range(0, len(x), 4096):
            block = np.ascontiguousarray(x[start : start + 4096])
            n, width = block.shape
            flat, base = block.ravel(), np.arange(n) * width
            total = np.zeros(n)
            for t in range(len(self.feature)):
                feature, threshold, child = self.feature[t], self.threshold[t], self.child[t]
                at = np.zeros(n, dtype=np.int64)
                for _ in range(self.depth):
                    at = child[at] + (flat[base + feature[at]] > threshold[at])
                total += self.path[t][at]
            mean = total / max(len(self.feature), 1)
            out[start : start + n] = -np.exp2(-mean / max(average_path(self.sample_size), 1e-12))
        return out

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.score_samples(x) - self.offset

    def nodes(self) -> pd.DataFrame:
        trees, size = self.feature.shape
        return pd.DataFrame(
            {
                "tree": np.repeat(np.arange(trees, dtype=np.int32), size),
                "node": np.tile(np.arange(size, dtype=np.int32), trees),
                "feature": self.feature.ravel().astype(np.int32),
                "threshold": self.threshold.ravel(),
                "child": self.child.ravel().astype(np.int32),
                "path": self.path.ravel(),
            }
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Node rows; nodes no tree uses are left out."""
        pdf = self.nodes()
        pdf = pdf[(pdf["path"] > 0) | (pdf["child"] != pdf["node"]) | (pdf["node"] == 0)]
        return spark.createDataFrame(pdf, NODE_SCHEMA).withColumns(
            {
                "sample_size": F.lit(self.sample_size),
                "contamination": F.lit(self.contamination),
                "offset": F.lit(float(self.offset)),
            }
        )

    @classmethod
    def from_df(cls, df: DataFrame, version: str) -> Forest:
        pdf = df.toPandas()  # at most trees x 511 node rows
        size, trees = int(pdf["sample_size"].iloc[0]), int(pdf["tree"].max()) + 1
        feature, threshold, child, path = _empty(trees, size)
        t, n = pdf["tree"].to_numpy(), pdf["node"].to_numpy()
        feature[t, n], threshold[t, n] = pdf["feature"], pdf["threshold"]
        child[t, n], path[t, n] = pdf["child"], pdf["path"]
        return cls(
            version, size, float(pdf["contamination"].iloc[0]), float(pdf["offset"].iloc[0]),
            feature, threshold, child, path,
        )


def _empty(trees: int, sample_size: int) -> tuple[np.ndarray, ...]:
    depth = max(1, math.ceil(math.log2(max(sample_size, 2))))
    shape = (trees, 2 ** (depth + 1) - 1)
    child = np.tile(np.arange(shape[1]), (trees, 1))
    return np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), child, np.zeros(shape)


def grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, threshold, child, path) of one tree; children of i: 2i+1, 2i+2."""
    out = []
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or len(usable) == 0:
            out.append((node, 0, math.inf, node, level + float(average_path(len(rows)))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        if cut >= high[f]:  # rounding may reach the top value
            cut = float(low[f])
        right = part[:, f] > cut
        out.append((node, f, cut, 2 * node + 1, 0.0))
        todo.append((2 * node + 2, rows[right], level + 1))
        todo.append((2 * node + 1, rows[~right], level + 1))
    return out


def _at_most(trees: int, p: float) -> list[float]:
    """P(at most k of the trees take a row), k = 0 .. trees - 1, each taking it with chance p."""
    out, total = [], 0.0
    for k in range(trees):
        log = math.lgamma(trees + 1) - math.lgamma(k + 1) - math.lgamma(trees - k + 1)
        total += math.exp(log + k * math.log(p) + (trees - k) * math.log1p(-p)) if p < 1 else 0.0
        out.append(total)
    return out


def tree_samples(
    df: DataFrame, vector: str, row_id: str, trees: int, sample_size: int, n: int, seed: int
) -> DataFrame:
    """Candidate rows per tree, about 1.5 samples each, picked by hash of the row id.

    Every tree takes every row with the same chance, whatever the number of rows and however
    they are partitioned: one hash gives the number of trees that take the row, and those with
    the smallest hashes of (row, tree) are the ones. Most rows of a large table cost one hash.
    """
    rows = df.select(F.col(row_id).cast("string").alias("id"), F.col(vector).alias("x"))
    below = _at_most(trees, min(1.0, 1.5 * sample_size / n))
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(HASH_RANGE)) + F.lit(0.5)) / F.lit(float(HASH_RANGE))
    rows = rows.select("id", "x", u.alias("u")).filter(F.col("u") >= below[0])
    taken = F.size(F.filter(F.array(*[F.lit(c) for c in below]), lambda c: c <= F.col("u")))
    ranked = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.struct(F.xxhash64("id", t, F.lit(seed + 1)).alias("h"), t.alias("tree")),
        )
    )
    drawn = F.transform(F.slice(ranked, F.lit(1), taken), lambda r: r["tree"])
    return rows.select(F.explode(drawn).alias("tree"), "id", "x").withColumn(
        "h", F.xxhash64("id", "tree", F.lit(seed + 2))
    )


def fit(
    df: DataFrame,
    vector: str,
    row_id: str,
    version: str = "v1",
    trees: int = 200,
    contamination: float = 0.05,
    seed: int = 42,
    max_samples: int = 256,
) -> Forest:
    """Grow the forest and set the offset at the contamination percentile of its scores."""
    n = df.count()
    if n == 0:
        raise ValueError("no rows to train on")
    size = min(max_samples, n)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"]).head(size)
        rng = np.random.default_rng([seed, int(key[0])])
        nodes = grow_tree(np.vstack(pdf["x"].to_numpy()).astype(float), limit, rng)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "child", "path"])
        out.insert(0, "tree", int(key[0]))
        return out

    pdf = (
        tree_samples(df, vector, row_id, trees, size, n, seed)
        .groupBy("tree")
        .applyInPandas(build, NODE_SCHEMA)
        .toPandas()  # at most trees x 511 node rows
    )
    feature, threshold, child, path = _empty(trees, size)
    t, node = pdf["tree"].to_numpy(), pdf["node"].to_numpy()
    feature[t, node], threshold[t, node] = pdf["feature"], pdf["threshold"]
    child[t, node], path[t, node] = pdf["child"], pdf["path"]
    grown = np.unique(t)  # a tree that drew no row at all is left out
    forest = Forest(
        version, size, contamination, 0.0,
        feature[grown], threshold[grown], child[grown], path[grown],
    )
    raw = df.select(score_column(forest, F.col(vector)).alias("s")).persist()
    try:
        forest.offset = exact_percentile(raw, "s", contamination)
    finally:
        raw.unpersist()
    return forest


def sweep(
    df: DataFrame, vector: str, forest: Forest, contaminations: tuple[float, ...] = (0.05, 0.1, 0.15)
) -> DataFrame:
    """Offset and flagged rows for several contaminations.

    Contamination only moves the offset, so the trees are grown and walked once.
    """
    raw = df.select(score_column(forest, F.col(vector)).alias("s")).persist()
    try:
        found = [(c, exact_percentile(raw, "s", c)) for c in contaminations]
        flagged = raw.agg(
            F.count("*"), *[F.count_if(F.col("s") < F.lit(offset)) for _, offset in found]
        ).first()
    finally:
        raw.unpersist()
    rows = [(c, o, n, flagged[0]) for (c, o), n in zip(found, flagged[1:])]
    return df.sparkSession.createDataFrame(
        rows, "contamination double, offset double, flagged bigint, rows bigint"
    )


def fold_of(row_id: Column, folds: int = 5) -> Column:
    """Fold number of a row, fixed by the first 32 bits of its id's MD5."""
    bits = F.conv(F.substring(F.md5(row_id.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(bits, F.lit(folds)).cast("int")


def cross_validate(
    df: DataFrame, vector: str, row_id: str, folds: int = 5, **fit_options
) -> DataFrame:
    """Per fold: a forest grown on the other folds, judged on this one."""
    numbered = df.withColumn("_fold", fold_of(F.col(row_id).cast("string"), folds)).persist()
    out = []
    try:
        for k in range(folds):
            model = fit(numbered.filter(F.col("_fold") != k), vector, row_id, f"fold-{k}", **fit_options)
            held_out = numbered.filter(F.col("_fold") == k).select(
                decide(model, F.col(vector)).alias("d")
            )
            out.append(
                held_out.agg(
                    F.lit(k).alias("fold"),
                    F.count("*").alias("rows"),
                    F.avg((F.col("d") < 0).cast("double")).alias("anomaly_rate"),
                    F.avg("d").alias("mean_decision_score"),
                ).first()
            )
    finally:
        numbered.unpersist()
    return df.sparkSession.createDataFrame(
        out, "fold int, rows bigint, anomaly_rate double, mean_decision_score double"
    )


def score_column(forest: Forest, vector: Column) -> Column:
    """``score_samples`` as a column; the node arrays go out once per model."""
    shared = forest.sent()

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Forest(*shared.value)
        for vectors in batches:
            yield pa.array(model.score_samples(matrix(vectors)))

    return score(vector)


def decide(forest: Forest, vector: Column) -> Column:
    """Decision value, below 0 for outliers."""
    return score_column(forest, vector) - F.lit(forest.offset)


def normalised(decision: Column) -> Column:
    """Decision as a score in 0..1, higher for outliers."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - decision))


def raw_flag(decision: Column) -> Column:
    return decision < 0


# --- thresholds: three rules are in use -------------------------------------------


def flag_raise(raw: Column, score: Column, threshold: float = ANOMALY_THRESHOLD) -> Column:
    """The model's own flag, or a score at the threshold: only ever raises."""
    return raw | (score >= threshold)


def flag_at_least(score: Column, threshold: float = ANOMALY_THRESHOLD) -> Column:
    return score >= threshold


def flag_above(score: Column, threshold: float = ANOMALY_THRESHOLD) -> Column:
    return score > threshold


# --- when there is no model ----------------------------------------------------------

FALLBACK_RANGES = {"worker": (0.05, 0.35), "engine": (0.0, 1.0), "error": (0.0, 0.0)}


def fallback_score(event_id: Column, mode: str = "worker") -> Column:
    """Stand-in score fixed by the event id, so a replay gives the same value."""
    low, high = FALLBACK_RANGES[mode]
    return hash_uniform(event_id, low, high)


def score_events(
    events: DataFrame,
    vector: str,
    forest: Forest | None,
    threshold: float = ANOMALY_THRESHOLD,
    processed_at: Column | None = None,
) -> DataFrame:
    """Scored-event records: score, flag, worker severity, version, time."""
    if forest is None:
        df = events.withColumn("anomaly_score", fallback_score(F.col("event_id")))
        return from_score(df, F.lit(False), "dummy-v0", threshold, processed_at)
    # The decision is named first so that the trees are walked once per row.
    df = events.withColumn("_decision", decide(forest, F.col(vector)))
    return from_decision(df, "_decision", forest.version, threshold, processed_at)


def from_decision(
    df: DataFrame,
    decision: str,
    version: str,
    threshold: float = ANOMALY_THRESHOLD,
    processed_at: Column | None = None,
) -> DataFrame:
    df = df.withColumn("anomaly_score", normalised(F.col(decision)))
    return from_score(df, raw_flag(F.col(decision)), version, threshold, processed_at)


def from_score(
    df: DataFrame,
    raw: Column,
    version: str,
    threshold: float = ANOMALY_THRESHOLD,
    processed_at: Column | None = None,
) -> DataFrame:
    from tidewarden.functions.severity import worker_severity

    df = df.withColumn("is_anomaly", flag_raise(raw, F.col("anomaly_score"), threshold))
    return scored_projection(
        df.withColumn("model_version", F.lit(version))
        .withColumn("severity", worker_severity(F.col("anomaly_score"), F.col("is_anomaly")))
        .withColumn("processed_at", F.current_timestamp() if processed_at is None else processed_at)
        .withColumn("event_date", F.col("event_time").cast("date"))
    )


def scored_projection(df: DataFrame) -> DataFrame:
    """Columns of the scored-event record that are present, in their order."""
    from tidewarden.schema import SCORED_EVENT

    return df.select(*[c for c in SCORED_EVENT.fieldNames() if c in df.columns])
