"""Views on the test tables that both a Spark query and its SQL twin start from."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table seen as scored events."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("double")
    score = F.least(F.lit(1.0), F.col("value") / F.lit(200.0))
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("source_id"),
        "event_type",
        ts.alias("event_time"),
        F.create_map(F.lit("k"), k, F.lit("value"), F.col("value")).alias("features"),
        F.array(k, F.col("value")).alias("feature_vector"),
        score.alias("anomaly_score"),
        (score >= 0.7).alias("is_anomaly"),
        F.when(F.col("event_id") % 3 == 0, "v1.0.0")
        .when(F.col("event_id") % 3 == 1, "v1.1.0")
        .otherwise("v2.0.0")
        .alias("model_version"),
        F.timestamp_millis(F.unix_millis(ts) + 50 + F.col("event_id") % 451).alias("processed_at"),
        ts.cast("date").alias("event_date"),
    )


# The same view in SQL; every oracle text starts from it.
SCORED_SQL = """
WITH scored AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS source_id, event_type,
         CAST(ts AS TIMESTAMP) AS event_time, (epoch_us(CAST(ts AS TIMESTAMP)) // 1000) AS ms,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value, props,
         least(1.0::DOUBLE, value / 200.0::DOUBLE) AS anomaly_score,
         least(1.0::DOUBLE, value / 200.0::DOUBLE) >= 0.7::DOUBLE AS is_anomaly,
         CASE event_id % 3 WHEN 0 THEN 'v1.0.0' WHEN 1 THEN 'v1.1.0' ELSE 'v2.0.0' END AS model_version,
         make_timestamp(((epoch_us(CAST(ts AS TIMESTAMP)) // 1000) + 50 + event_id % 451) * 1000) AS processed_at,
         CAST(ts AS DATE) AS event_date, event_id AS n
  FROM events)
"""


def portable(df: DataFrame) -> DataFrame:
    """Instants as zone-less UTC times, the form the SQL twins return."""
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp_ntz"))
    return df
