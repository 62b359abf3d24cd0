"""Exact order statistics and prefix sums that stay distributed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_percentile(df: DataFrame, column: str, q: float, keep: int = 100_000) -> float | None:
    """Percentile with linear interpolation, exact, without gathering the column.

    ``percentile`` holds every distinct value in one task. Here approximate percentiles give
    two values around the wanted rank and counting tells on which side of them, or on which of
    them, the rank lies. Both are values of the column and drop out, so ties of any weight end
    the search and the open range shrinks until at most ``keep`` values are left to sort.
    """
    x = F.col(column)
    values = df.select(x.cast("double").alias(column)).filter(x.isNotNull() & ~F.isnan(x))
    n = values.count()
    if n == 0:
        return None
    rank = (n - 1) * q
    k = math.floor(rank)
    last = min(k + 1, n - 1)
    found = _ranked(values, column, n, k, last, keep)
    first, second = found if len(found) == 2 else (found[0], _ranked(values, column, n, last, last, keep)[0])
    return first + (rank - k) * (second - first)


def _ranked(values: DataFrame, column: str, n: int, k: int, last: int, keep: int) -> list[float]:
    """The values of rank k and, where it comes with it, of rank ``last``."""
    x = F.col(column)
    inside, below, size = values, 0, n
    while size > keep:
        at, slack = (k - below) / size, 4.0 / ACCURACY
        lo, hi = inside.agg(
            F.percentile_approx(x, [max(0.0, at - slack), min(1.0, at + slack + 2.0 / size)], ACCURACY)
        ).first()[0]
        under, low, between, high = inside.agg(
            F.count_if(x < lo), F.count_if(x == lo), F.count_if((x > lo) & (x < hi)), F.count_if((x == hi) & (x > lo))
        ).first()
        parts = [(under, x < lo, None), (low, None, lo), (between, (x > lo) & (x < hi), None),
                 (high, None, hi), (size - under - low - between - high, x > hi, None)]
        for rows, where, value in parts:
            if k < below + rows:
                break
            below += rows
        if value is not None:
            return [value, value] if last < below + rows else [value]
        inside, size = inside.filter(where), rows
    found = inside.orderBy(x).limit(keep + 1).collect()  # ``keep`` values at most
    return [r[0] for r in found[k - below : last - below + 1]]


def edges(df: DataFrame, column: str, parts: int) -> list[float]:
    """Inner edges of about equally filled ranges, strictly increasing.

    The ranges only balance work, so approximate percentiles are enough.
    """
    found = df.agg(
        F.percentile_approx(column, [i / parts for i in range(1, parts)], ACCURACY)
    ).first()[0]
    return sorted(set(found or []))


def with_range(df: DataFrame, column: str, inner: list[float], name: str) -> DataFrame:
    """Index of the range between the inner edges a value falls in (edge: upper range)."""
    from pyspark.ml.feature import Bucketizer

    splits = [-math.inf, *inner, math.inf]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    out = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)
    return out.withColumn(name, F.col(name).cast("int"))


def running_total(
    df: DataFrame, order: str, amount: str, name: str, parts: int = 256
) -> DataFrame:
    """Sum of ``amount`` over all rows with a smaller ``order``; ``order`` is unique.

    Ranges of the order column are summed first, the range totals (at most
    ``parts`` rows) are accumulated, and each range finishes on its own.
    """
    ranged = with_range(df, order, edges(df, order, parts), "_range")
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_range"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    inner = (
        Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(starts, "_range")
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .drop("_range", "_start")
    )
