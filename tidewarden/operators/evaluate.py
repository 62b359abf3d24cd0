"""Model quality: confusion metrics, ROC area, fit summaries, drift index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.quantiles import running_total, with_range


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def classification(df: DataFrame, flag: str, label: str, by: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 of a flag against a 0/1 label."""
    tp = F.count_if(F.col(flag) & (F.col(label) == 1))
    fp = F.count_if(F.col(flag) & (F.col(label) == 0))
    fn = F.count_if(~F.col(flag) & (F.col(label) == 1))
    counts = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return from_counts(counts, by)


def from_counts(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    c = F.col
    return counts.select(
        *by,
        _ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        _ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
    )


def roc_auc(df: DataFrame, score: str, label: str) -> float:
    """Exact area under the ROC curve, ties at half weight; 0 with one class only.

    Rows are reduced to one per distinct score, and the count of negatives below
    each score comes from a two-step running total.
    """
    per_score = (
        df.groupBy(F.col(score).cast("double").alias("_s"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
        .persist()
    )
    try:
        pos, neg = per_score.agg(F.sum("pos"), F.sum("neg")).first()
        if not pos or not neg:
            return 0.0
        below = running_total(per_score, "_s", "neg", "_below")
        area = below.agg(F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0))).first()[0]
        return area / (pos * neg)
    finally:
        per_score.unpersist()


def fit_summary(scored: DataFrame, decision: str = "decision") -> DataFrame:
    """Share of outliers and mean and population deviation of the decision score."""
    return scored.agg(
        F.avg((F.col(decision) < 0).cast("double")).alias("anomaly_rate"),
        F.avg(decision).alias("mean_decision_score"),
        F.stddev_pop(decision).alias("std_decision_score"),
    )


def psi(
    baseline: DataFrame, current: DataFrame, column: str, bins: int = 10, floor: float = 1e-4,
    inner: list[float] | None = None,
) -> DataFrame:
    """Population stability index over bins of equal baseline share.

    Result: one row with ``psi``. An empty share counts as ``floor``. Bin edges
    are baseline percentiles (relative rank error 1/10 000).
    """
    if inner is None:
        inner = sorted(
            set(
                baseline.agg(
                    F.percentile_approx(column, [i / bins for i in range(1, bins)], 10_000)
                ).first()[0]
            )
        )
    both = baseline.select(column, F.lit(1).alias("b")).unionByName(
        current.select(column, F.lit(0).alias("b"))
    )
    per_bin = (
        with_range(both, column, inner, "_bin")
        .groupBy("_bin")
        .agg(F.sum("b").alias("old"), F.sum(1 - F.col("b")).alias("new"))
    )
    totals = per_bin.agg(F.sum("old").alias("old_all"), F.sum("new").alias("new_all")).first()
    old_all, new_all = totals["old_all"] or 0, totals["new_all"] or 0
    p = F.greatest(F.col("new") / F.lit(max(new_all, 1)), F.lit(floor))
    q = F.greatest(F.col("old") / F.lit(max(old_all, 1)), F.lit(floor))
    return per_bin.agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


CELL = 1e-4


def share_sketch(events: DataFrame, column: str, by: str | None = None, width: float = CELL) -> DataFrame:
    """Rows per cell of a column with a bounded range: a quantile sketch that merges by adding.

    At most range / width cells per group, so the baseline of a model version is a small table that
    is stored once; days or parts of it can be sketched apart and merged.
    """
    x = F.col(column).cast("double")
    kept = events.filter(x.isNotNull() & ~F.isnan(x)).withColumn("cell", F.floor(x / F.lit(width)))
    return kept.groupBy(*([by] if by else []), "cell").agg(F.count("*").alias("n"))


def merge_sketches(parts: DataFrame) -> DataFrame:
    """One sketch of several: the counts of equal cells added."""
    return parts.groupBy(*[c for c in parts.columns if c != "n"]).agg(F.sum("n").alias("n"))


def sketch_edges(sketch: DataFrame, bins: int = 10) -> list[int]:
    """Cells that begin a new bin: each bin but the last holds its share of the rows or more."""
    upto = F.sum("n").over(Window.orderBy("cell"))
    shares = sketch.select("cell", upto.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    hits = [F.min(F.when(F.col("upto") * bins >= F.col("all") * i, F.col("cell") + 1)) for i in range(1, bins)]
    return sorted({e for e in shares.agg(*hits).first() if e is not None})


def psi_of_sketch(
    sketch: DataFrame, current: DataFrame, column: str, bins: int = 10, floor: float = 1e-4, width: float = CELL
) -> DataFrame:
    """``psi`` against a stored sketch (cell, n): the baseline's events are not read again.

    Edges lie between cells, so the baseline shares are exact; only the edges are rounded to a cell.
    """
    edges = F.array(*[F.lit(e).cast("bigint") for e in sketch_edges(sketch, bins)]).cast("array<bigint>")
    index = F.size(F.filter(edges, lambda e: e <= F.col("cell")))
    now = share_sketch(current, column, width=width).select("cell", F.lit(0).cast("bigint").alias("old"), F.col("n").alias("new"))
    both = sketch.select("cell", F.col("n").alias("old"), F.lit(0).cast("bigint").alias("new")).unionByName(now)
    per_bin = both.groupBy(index.alias("bin")).agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    whole = Window.partitionBy()
    share = lambda c: F.greatest(F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1)), F.lit(floor))
    per_bin = per_bin.select(share("new").alias("p"), share("old").alias("q"))
    return per_bin.agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"))


def drift_gate(index: DataFrame, threshold: float = 0.25) -> DataFrame:
    return index.withColumn("retrain", F.col("psi") > threshold)


def error_thresholds(df: DataFrame, error: str) -> DataFrame:
    """Reconstruction threshold: mean + 3 population deviations."""
    return df.agg((F.avg(error) + 3 * F.stddev_pop(error)).alias("threshold"))


def model_quality(
    labels: DataFrame, events: DataFrame, by_day: bool = False
) -> DataFrame:
    """Quality per model version from analyst labels joined to the events they judge."""
    from pyspark.sql import functions as f

    keys = ["model_version"] + (["label_date"] if by_day else [])
    joined = labels.withColumn("label_date", F.col("labeled_at").cast("date")).join(
        events.select("event_id", "model_version"), "event_id"
    )
    one = lambda name: f.count_if(F.col("label") == name)
    counts = joined.groupBy(*keys).agg(
        one("TP").alias("tp"), one("FP").alias("fp"), one("TN").alias("tn"), one("FN").alias("fn"),
        F.max("labeled_at").alias("evaluation_date"),
    )
    right = F.col("tp") + F.col("tn")
    every = right + F.col("fp") + F.col("fn")
    return from_counts(
        counts.withColumn("accuracy", _ratio(right, every)), [*keys, "accuracy", "evaluation_date"]
    )


def model_versions(events: DataFrame, quality: DataFrame, active: str | None = None) -> DataFrame:
    """Versions seen in the data with first use, quality and whether they are active."""
    newest = F.struct("event_time", "event_id")
    if active is None:
        active = events.agg(F.max_by("model_version", newest)).first()[0]
    seen = events.groupBy("model_version").agg(F.min("event_time").alias("registered_at"))
    return seen.join(quality, "model_version", "left").withColumn(
        "active", F.col("model_version") == F.lit(active)
    )
