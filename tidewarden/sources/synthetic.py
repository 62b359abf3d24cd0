"""Reproducible made-up events for trials and tests."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.identity import hash_uniform, uuid5
from tidewarden.functions.severity import alert_severity
from tidewarden.functions.timebuckets import literal_ts
from tidewarden.schema import ANOMALY_THRESHOLD, PROBE_FEATURES, SEED_TOPS


def uniform(seed: int) -> Column:
    """0..1, fixed by row id and seed, so the partitioning does not change the data."""
    return hash_uniform(F.col("id"), 0.0, 1.0, seed)


def gauss(seed: int) -> Column:
    """Standard normal from two uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(2 * seed)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(2 * seed + 1))


def synthetic_events(
    spark: SparkSession,
    n: int,
    as_of: dt.datetime,
    n_features: int = 10,
    anomaly_probability: float = 0.05,
    sources: int = 20,
    seed: int = 42,
) -> DataFrame:
    """Raw events in list form: N(0,1) features, a share of them N(5,3)."""
    normal = [gauss(seed + 1 + i) for i in range(n_features)]
    odd = F.col("injected_anomaly")
    return (
        spark.range(n)
        .withColumn("injected_anomaly", uniform(seed) < anomaly_probability)
        .select(
            uuid5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))).alias("event_id"),
            F.concat(F.lit("source-"), (F.floor(uniform(seed + 100) * sources) + 1).cast("string")).alias(
                "source_id"
            ),
            F.array(*[F.when(odd, g * 3.0 + 5.0).otherwise(g) for g in normal]).alias(
                "feature_vector"
            ),
            literal_ts(as_of).alias("event_time"),
            "injected_anomaly",
        )
    )


def seed_table(spark: SparkSession, as_of: dt.datetime, n: int = 1000, seed: int = 42) -> DataFrame:
    """Scored events over 7 days: 5 sources, 30 % anomalous, 3 model versions."""
    s = F.col("id")
    odd = s % 10 >= 7
    sizes = SEED_TOPS
    pairs = [
        x
        for i, (name, top) in enumerate(sizes.items())
        for x in (F.lit(name), F.round(uniform(seed + 10 + i) * top, 4))
    ]
    now = literal_ts(as_of)
    back_us = (uniform(seed + 1) * F.lit(7 * 86_400 * 1_000_000)).cast("bigint")
    lag_us = ((uniform(seed + 3) * 0.45 + 0.05) * 1_000_000).cast("bigint")
    score = F.when(odd, uniform(seed + 2) * 0.30 + 0.70).otherwise(uniform(seed + 2) * 0.65)
    return (
        spark.range(n)
        .select(
            uuid5(F.concat(F.lit(f"seed-{seed}-"), s.cast("string"))).alias("event_id"),
            F.timestamp_micros(F.unix_micros(now) - back_us).alias("event_time"),
            F.concat(F.lit("src-"), F.lpad((s % 5 + 1).cast("string"), 3, "0")).alias("source_id"),
            F.create_map(*pairs).alias("features"),
            F.round(score, 6).alias("anomaly_score"),
            odd.alias("is_anomaly"),
            F.when(s % 3 == 0, "v1.0.0").when(s % 3 == 1, "v1.1.0").otherwise("v2.0.0").alias(
                "model_version"
            ),
            lag_us.alias("_lag"),
        )
        .withColumn(
            "processed_at", F.timestamp_micros(F.unix_micros("event_time") + F.col("_lag"))
        )
        .drop("_lag")
    )


def training_data(
    spark: SparkSession, n: int, n_features: int = 10, spread: float = 3.0, share: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """Standard normal vectors and a share of wider ones (3 for forests, 4 for autoencoders)."""
    def part(count: int, factor: float, base: int, odd: int) -> DataFrame:
        return spark.range(count).select(
            (F.col("id") + F.lit(odd * n)).alias("id"),
            F.array(*[gauss(base + i) * factor for i in range(n_features)]).alias("vector"),
            F.lit(odd).alias("label"),
        )

    return part(n, 1.0, seed, 0).unionByName(part(int(n * share), spread, seed + 1000, 1))


def at_scores(scores: DataFrame, as_of: dt.datetime, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """A scored event for every (source_id, score), as sent straight to alerting."""
    score = F.col("score")
    names = ["f0", "f1", "f2", "f3", "f4"]
    values = [F.lit(PROBE_FEATURES[n]) if n in PROBE_FEATURES else score for n in names]
    return scores.select(
        uuid5(F.concat_ws("|", "source_id", score.cast("string"))).alias("event_id"),
        "source_id",
        F.lit("synthetic-test").alias("event_type"),
        F.create_map(*[x for n, v in zip(names, values) for x in (F.lit(n), v)]).alias("features"),
        literal_ts(as_of).alias("event_time"),
        score.alias("anomaly_score"),
        (score >= threshold).alias("is_anomaly"),
        alert_severity(score).alias("severity"),
        F.lit("synthetic-test-v1").alias("model_version"),
        literal_ts(as_of).alias("processed_at"),
    )
