"""Position and running sums along each key's timeline, in two steps.

A window over a whole key would put a source that owns a third of all rows into
one task. The timeline is cut into chunks instead: chunk totals are accumulated
per key (one row per chunk, bounded by the time span), and every chunk then
finishes on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_prefix(
    df: DataFrame,
    key: str,
    ms: str,
    tie: str,
    sums: dict[str, Column] | None = None,
    chunk_ms: int = 300_000,
    position: str = "_pos",
) -> DataFrame:
    """Adds the row's position within its key (from 0) and exclusive running sums."""
    sums = sums or {}
    base = df.withColumn("_chunk", F.floor(F.col(ms) / F.lit(chunk_ms)))
    for name, value in sums.items():
        base = base.withColumn(f"_v_{name}", value)
    totals = base.groupBy(key, "_chunk").agg(
        F.count("*").alias("_n"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    )
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        F.col(key),
        F.col("_chunk"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0.0)).alias(f"_s_{n}") for n in sums],
    )
    order = Window.partitionBy(key, "_chunk").orderBy(ms, tie)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = base.join(starts, [key, "_chunk"])
    out = out.withColumn(position, F.col("_start") + F.row_number().over(order) - 1)
    for name in sums:
        out = out.withColumn(
            name, F.col(f"_s_{name}") + F.coalesce(F.sum(f"_v_{name}").over(before), F.lit(0.0))
        )
    return out.drop(
        "_chunk", "_start", *[f"_v_{n}" for n in sums], *[f"_s_{n}" for n in sums]
    )
