"""Feature vectors: alignment, imputation, skew, scaling, time and series features."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewarden.operators.sweep import STORM, markers, running, storms
from tidewarden.schema import ALL_FEATURES, ALL_SKEWED, SERVING_FEATURES, SERVING_SKEWED


@dataclass(frozen=True)
class Scaler:
    """Fitted scaling parameters; the declared order is the vector order."""

    version: str
    names: list[str]
    mean: list[float]
    scale: list[float]
    skewed: list[str] = field(default_factory=list)

    def to_rows(self) -> list[tuple]:
        return [
            (self.version, i, n, float(m), float(s), n in self.skewed)
            for i, (n, m, s) in enumerate(zip(self.names, self.mean, self.scale))
        ]

    SCHEMA = (
        "version string, position int, name string, mean double, scale double, skewed boolean"
    )

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.to_rows(), self.SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame, version: str) -> Scaler:
        rows = df.filter(F.col("version") == version).orderBy("position").collect()
        if not rows:
            raise LookupError(f"no scaler {version!r}")
        return cls(
            version,
            [r.name for r in rows],
            [r["mean"] for r in rows],
            [r["scale"] for r in rows],
            [r.name for r in rows if r.skewed],
        )


def fallback_scaler() -> Scaler:
    """What serving starts from when nothing is fitted yet: mean 0, scale 1."""
    n = len(ALL_FEATURES)
    return Scaler("dummy-v0", list(ALL_FEATURES), [0.0] * n, [1.0] * n, list(ALL_SKEWED))


def zero_vector(names: list[str] | None = None) -> Column:
    """Vector used when no scaler is usable."""
    return F.array(*[F.lit(0.0) for _ in names or ALL_FEATURES])


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null."""
    x = x.cast("double")
    # NaN sorts above infinity, so one comparison drops both.
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def unskew(x: Column) -> Column:
    """log(1 + max(x, 0)); null stays null, which ``greatest`` would turn to 0."""
    return F.log1p(F.when(x < 0, F.lit(0.0)).otherwise(x))


def _value(features: Column, name: str | Column) -> Column:
    return F.try_element_at(features, F.lit(name))


def align(features: Column, names: list[str]) -> Column:
    """Values in declared order, 0 where a name is absent."""
    return F.array(*[F.coalesce(_value(features, n).cast("double"), F.lit(0.0)) for n in names])


def prepared(
    features: Column, name: str, skewed: list[str], impute: str = "mean"
) -> Column:
    """One value before scaling.

    ``raw_zero`` puts 0 for a bad value here, before log and scaling. ``mean``
    leaves null, which scaling later turns into 0, i.e. the column mean.
    """
    x = _imputed(features, name, impute)
    return unskew(x) if name in skewed else x


def _imputed(features: Column, name: str | Column, impute: str) -> Column:
    x = finite(_value(features, name))
    if impute == "raw_zero":
        return F.coalesce(x, F.lit(0.0))
    if impute != "mean":
        raise ValueError("impute must be 'raw_zero' or 'mean'")
    return x


def fit_scaler(
    df: DataFrame,
    names: list[str] = SERVING_FEATURES,
    skewed: list[str] = SERVING_SKEWED,
    version: str = "v1",
    impute: str = "mean",
    features: str = "features",
) -> Scaler:
    """Mean and population deviation of every feature in one aggregation."""
    cols = [prepared(F.col(features), n, skewed, impute) for n in names]
    stats = []
    for i, c in enumerate(cols):
        stats += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"),
                  F.stddev_pop(c).alias(f"s{i}")]
    r = df.agg(*stats).first()
    mean = [r[f"m{i}"] or 0.0 for i in range(len(names))]
    scale = [
        _usable_scale(r[f"s{i}"] or 0.0, mean[i], r[f"n{i}"]) for i in range(len(names))
    ]
    return Scaler(version, list(names), mean, scale, [n for n in names if n in skewed])


def _usable_scale(std: float, mean: float, n: int) -> float:
    """1 for a column that is constant up to rounding error, as fitted scalers do."""
    eps = 2.220446049250313e-16
    if not math.isfinite(std) or std * std <= n * eps * std * std + (n * mean * eps) ** 2:
        return 1.0
    return std


def scaled_vector(features: Column, scaler: Scaler, impute: str = "mean") -> Column:
    """Scaled feature array; a zero scale or a missing value gives 0."""
    if not scaler.names:
        return F.array()
    # One short expression over a list of parameters: written out for every feature, the generated
    # method grows beyond what the JVM compiles.
    params = [
        F.struct(F.lit(n).alias("name"), F.lit(float(m)).alias("mean"), F.lit(float(s)).alias("scale"), F.lit(n in scaler.skewed).alias("skewed"))
        for n, m, s in zip(scaler.names, scaler.mean, scaler.scale)
    ]

    def scaled(p: Column) -> Column:
        x = _imputed(features, p["name"], impute)
        x = F.when(p["skewed"], unskew(x)).otherwise(x)
        return F.when(p["scale"] == 0.0, F.lit(0.0)).otherwise(F.coalesce((x - p["mean"]) / p["scale"], F.lit(0.0)))

    return F.transform(F.array(*params), scaled)


def normalise_vector(vector: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / (std + 1e-8), the form the autoencoder is trained on."""
    return F.array(
        *[
            (F.get(vector, F.lit(i)) - F.lit(m)) / F.lit(s + 1e-8)
            for i, (m, s) in enumerate(zip(mean, std))
        ]
    )


def vector_moments(df: DataFrame, vector: str, width: int) -> tuple[list[float], list[float]]:
    """Mean and population deviation of the finite values per position; 1 for a constant one."""
    stats = []
    for i in range(width):
        x = finite(F.get(F.col(vector), F.lit(i)))
        stats += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = df.agg(*stats).first()
    mean = [r[f"m{i}"] or 0.0 for i in range(width)]
    return mean, [_usable_scale(r[f"s{i}"] or 0.0, mean[i], r[f"n{i}"]) for i in range(width)]


# --- features that are only named elsewhere; the formulas are this library's ---


def with_temporal(
    df: DataFrame, ts: str = "event_time", zone: str = "UTC",
    opens: int = 9 * 60 + 30, closes: int = 16 * 60,
) -> DataFrame:
    """hour_of_day, day_of_week (Monday 0) and is_market_hours (Mon-Fri, open to close)."""
    local = F.from_utc_timestamp(F.col(ts), zone)
    minute = F.hour(local) * 60 + F.minute(local)
    trading = (F.weekday(local) < 5) & (minute >= opens) & (minute < closes)
    return (
        df.withColumn("hour_of_day", F.hour(local))
        .withColumn("day_of_week", F.weekday(local))
        .withColumn("is_market_hours", trading)
    )


def with_rolling(
    df: DataFrame,
    value: str,
    key: str = "source_id",
    ts: str = "event_time",
    width_ms: int = 300_000,
    chunk_ms: int = 900_000,
    storm: int = STORM,
) -> DataFrame:
    """Mean and population deviation of the last 5 minutes, this row included.

    Adds rolling_mean_5m, rolling_std_5m, deviation_from_mean and volume_z_score.
    Sums are taken around the chunk mean, which keeps the variance free of
    cancellation when values are large against their spread.
    """
    if chunk_ms <= width_ms:
        raise ValueError("a chunk must be longer than the window")
    base = df.withColumn("_ms", F.unix_millis(ts)).withColumn("_x", F.col(value).cast("double"))
    m = markers(base, key, "_ms", F.col("_ms") + F.lit(width_ms + 1),
                F.col("_x").isNotNull(), chunk_ms, ["_x"])
    m, hot = storms(m, [key, "chunk"], storm)
    whole = Window.partitionBy(key, "chunk")
    so_far = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = F.col("_x") - F.col("_c")
    parts = {"_n": F.col("sign"), "_s1": F.col("sign") * d, "_s2": F.col("sign") * d * d}
    out = m.withColumn("_c", F.avg("_x").over(whole))
    for name, part in parts.items():
        out = out.withColumn(name, F.sum(part).over(so_far))
    out = out.filter(F.col("row").isNotNull())
    if hot is not None:
        # A chunk with very many rows is summed by millisecond first: what a task then accumulates
        # is bounded by the length of the chunk, and the rows find their totals by a join.
        centre = hot.groupBy(F.col(key).alias("_ck"), F.col("chunk").alias("_cc")).agg(F.avg("_x").alias("_c"))
        centred = hot.join(F.broadcast(centre), F.col(key).eqNullSafe(F.col("_ck")) & (F.col("chunk") == F.col("_cc")))
        cells = centred.groupBy(F.col(key).alias("_k"), F.col("chunk").alias("_q"), F.col("at").alias("_t"))
        cells = cells.agg(F.first("_c").alias("_c"), *[F.sum(part).alias(name) for name, part in parts.items()])
        upto = Window.partitionBy("_k", "_q").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.select("_k", "_q", "_t", "_c", *[F.sum(name).over(upto).alias(name) for name in parts])
        met = F.col(key).eqNullSafe(F.col("_k")) & (F.col("chunk") == F.col("_q")) & (F.col("at") == F.col("_t"))
        found = hot.filter(F.col("row").isNotNull()).join(cells, met).select(*out.columns)
        out = out.unionByName(found)
    mean = F.when(F.col("_n") > 0, F.col("_s1") / F.col("_n"))
    # One value in the window has no spread; below that rounding may dip under 0.
    var = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(
        F.greatest(F.col("_s2") / F.nullif(F.col("_n"), F.lit(0)) - mean * mean, F.lit(0.0))
    )
    out = out.withColumn("rolling_mean_5m", mean + F.col("_c")).withColumn(
        "rolling_std_5m", F.when(F.col("_n") > 0, F.sqrt(var))
    )
    gap = F.col(value).cast("double") - F.col("rolling_mean_5m")
    return (
        out.select("row.*", "rolling_mean_5m", "rolling_std_5m")
        .drop("_ms", "_x")
        .withColumn("deviation_from_mean", gap)
        .withColumn(
            "volume_z_score",
            F.when(F.col("rolling_std_5m") > 0, gap / F.col("rolling_std_5m")).otherwise(
                F.when(gap.isNotNull(), F.lit(0.0))
            ),
        )
    )


def with_return(
    df: DataFrame,
    value: str,
    key: str = "source_id",
    ts: str = "event_time",
    tie: str = "event_id",
    lag_ms: int = 60_000,
    look_back_ms: int = 300_000,
    chunk_ms: int = 900_000,
    storm: int = STORM,
) -> DataFrame:
    """price_return_1m: value / value one minute earlier - 1.

    The earlier value is the newest one at or before t - lag, not older than
    ``look_back_ms`` before that. Null where there is none or where it is 0.
    """
    if chunk_ms <= look_back_ms:
        raise ValueError("a chunk must be longer than the look-back")
    t = F.unix_millis(ts)
    base = df.withColumn("_ms", t).withColumn("_x", F.col(value).cast("double"))
    chunk_of = lambda c: F.floor(c / F.lit(chunk_ms))
    seen = F.col("_ms") + F.lit(lag_ms)
    last = seen + F.lit(look_back_ms)

    def marker(chunk: Column, at: Column, phase: int, row: Column) -> Column:
        return F.struct(chunk.alias("chunk"), at.alias("at"), F.lit(phase).alias("phase"),
                        row.alias("row"))

    reader = marker(chunk_of(F.col("_ms")), F.col("_ms"), 1,
                    F.struct(*[F.col(c) for c in base.columns]))
    known = marker(chunk_of(seen), seen, 0, F.lit(None))
    again = marker(chunk_of(last), seen, 0, F.lit(None))
    usable = F.col("_x").isNotNull()
    marks = (
        F.when(usable & (chunk_of(seen) != chunk_of(last)), F.array(reader, known, again))
        .when(usable, F.array(reader, known))
        .otherwise(F.array(reader))
    )
    past = F.when(F.col("phase") == 0, F.struct(F.col("at"), F.col("_x").alias("x")))
    ratio = F.col("_x") / F.nullif(F.col("_past.x"), F.lit(0.0)) - 1
    fresh = F.col("_past.at") >= F.col("_ms") - F.lit(look_back_ms)
    m = base.select(key, tie, "_x", F.explode(marks).alias("m")).select(key, tie, "_x", "m.*")
    m = running(m, [key, "chunk"], ["at", "phase", tie], newest={"_past": past}, most=storm)
    return (
        m.filter(F.col("phase") == 1)
        .select("row.*", "_past")
        .withColumn("price_return_1m", F.when(fresh, ratio))
        .drop("_ms", "_x", "_past")
    )
