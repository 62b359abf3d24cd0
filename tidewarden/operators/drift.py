"""Page-Hinkley drift detection (Page 1954), streaming and batch.

The detector follows the running mean and the faded sums of deviations from it,
and signals once a sum has moved more than ``threshold`` from its extreme. After a
signal it starts afresh with the next value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.operators.ordered import with_prefix
from tidewarden.session import cut_lineage, shared_dir


LOOK_AHEAD = 4
SEARCH_ROWS = 1_000_000
PIECE = 4096


@dataclass(frozen=True)
class Params:
    min_instances: int = 500
    delta: float = 0.005
    threshold: float = 50.0
    fade: float = 1 - 0.0001


@dataclass
class State:
    n: int = 0
    total: float = 0.0
    up: float = 0.0
    down: float = 0.0
    up_min: float = float("inf")
    down_max: float = float("-inf")


def update(s: State, x: float, p: Params) -> bool:
    """Feed one value; True on a signal, after which the state is fresh."""
    s.n += 1
    s.total += x
    gap = x - s.total / s.n
    s.up = p.fade * s.up + gap - p.delta
    s.down = p.fade * s.down + gap + p.delta
    s.up_min = min(s.up_min, s.up)
    s.down_max = max(s.down_max, s.down)
    if s.n >= p.min_instances and (
        s.up - s.up_min > p.threshold or s.down_max - s.down > p.threshold
    ):
        s.__init__()
        return True
    return False


def _deviations(x: np.ndarray, n0: int, total0: float) -> np.ndarray:
    """x minus the running mean, given count and sum before the block."""
    return x - (total0 + np.cumsum(x)) / (n0 + 1 + np.arange(len(x)))


def _faded(step: np.ndarray, start: float, fade: float) -> np.ndarray:
    """s[i] = fade * s[i-1] + step[i], in pieces short enough for plain powers."""
    out = np.empty(len(step))
    for a in range(0, len(step), PIECE):
        part = step[a : a + PIECE]
        power = fade ** np.arange(1, len(part) + 1)
        out[a : a + PIECE] = power * (start + np.cumsum(part / power))
        start = out[a + len(part) - 1]
    return out


def _sums(x: np.ndarray, n0: int, total0: float, up0: float, down0: float, p: Params):
    gap = _deviations(x, n0, total0)
    return _faded(gap - p.delta, up0, p.fade), _faded(gap + p.delta, down0, p.fade)


def fold(s: State, x: np.ndarray, p: Params) -> tuple[State, np.ndarray]:
    """(state behind the values, places of the signals): ``update`` over an array, a piece at once.

    What lies behind a signal is worked out again from there, so pieces are short: the time goes
    with values and signals, not with their product.
    """
    at, start = [], 0
    while start < len(x):
        rest = x[start : start + PIECE]
        up, down = _sums(rest, s.n, s.total, s.up, s.down, p)
        low = np.minimum(np.minimum.accumulate(up), s.up_min)
        high = np.maximum(np.maximum.accumulate(down), s.down_max)
        ripe = s.n + 1 + np.arange(len(rest)) >= p.min_instances
        hit = np.flatnonzero(ripe & ((up - low > p.threshold) | (high - down > p.threshold)))
        if len(hit):
            start += int(hit[0]) + 1
            at.append(start - 1)
            s = State()
        else:
            start += len(rest)
            s = State(s.n + len(rest), s.total + float(rest.sum()), float(up[-1]), float(down[-1]), float(low[-1]), float(high[-1]))
    return s, np.array(at, "int64")


def batch_drifts(
    df: DataFrame,
    key: str,
    value: str,
    ts: str = "event_time",
    tie: str = "event_id",
    params: Params = Params(),
    block_rows: int = 200_000,
    chunk_ms: int = 300_000,
) -> DataFrame:
    """Rows on which the detector of their key signals, as if fed in time order.

    No key is gathered. Its rows are numbered and cut into blocks of
    ``block_rows``. Between two signals the detector is a chain of sums, so block
    results are chained: counts and totals, then the faded sums, then their
    extremes. From the first block that must contain a signal on, one task folds
    the rows one by one, through ``SEARCH_ROWS`` of them or ``LOOK_AHEAD`` blocks, whichever
    is more. As a signal resets the detector, the search goes on from the row after
    the last one. A key looks ``LOOK_AHEAD`` blocks ahead, then twice as many, until it
    finds a signal or its end, so all rounds together read each block a few times only, and
    where signals are dense there is a round per such stretch, however small a block is.
    """
    types = dict(df.dtypes)
    spark = df.sparkSession
    base = df.select(
        F.col(key), F.col(tie), F.unix_millis(ts).alias("_ms"), F.col(value).cast("double").alias("_x")
    )
    numbered = with_prefix(base, key, "_ms", tie, chunk_ms=chunk_ms).withColumn(
        "_block", F.floor(F.col("_pos") / block_rows)
    )
    search = max(LOOK_AHEAD, SEARCH_ROWS // block_rows)
    # Stored by stretch of blocks: a round opens the files of those it looks at.
    path = shared_dir(spark, "drift-rows")
    numbered = numbered.withColumn("_stretch", F.floor(F.col("_block") / search))
    numbered.write.partitionBy("_stretch").parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    # Per key: the last signal, how many blocks to look ahead, and its last block.
    state = rows.groupBy(F.col(key).alias("_k")).agg(
        F.lit(-1).cast("bigint").alias("_from"), F.lit(LOOK_AHEAD).cast("bigint").alias("_ahead"), F.max("_block").alias("_end")
    )
    state = cut_lineage(state)
    found: list[DataFrame] = []
    first = F.floor((F.col("_from") + 1) / block_rows)
    reach = first + F.col("_ahead") - 1
    while True:
        span = state.agg(F.min(first), F.max(reach)).first()
        if span[0] is None:
            break
        near = rows.filter(F.col("_stretch").between(span[0] // search, (span[1] + search) // search))
        live = near.filter(F.col("_block").between(span[0], span[1])).join(state, F.col(key).eqNullSafe(F.col("_k"))).filter(
            (F.col("_pos") > F.col("_from")) & (F.col("_block") <= reach)
        )
        # Written down: the next round starts behind these rows.
        hits = cut_lineage(_first_signals(live.select(*rows.columns), near, key, types[key], params, search))
        found.append(hits)
        last = hits.groupBy(F.col(key).alias("_h")).agg(F.max("_pos").alias("_hit"))
        state = state.join(last, F.col("_k").eqNullSafe(F.col("_h")), "left")
        # Without a signal up to its end a key is done.
        state = state.filter(F.col("_hit").isNotNull() | (reach < F.col("_end")))
        state = state.select(
            "_k",
            F.coalesce("_hit", "_from").alias("_from"),
            F.when(F.col("_hit").isNull(), F.col("_ahead") * 2).otherwise(LOOK_AHEAD).alias("_ahead"),
            "_end",
        )
        state = cut_lineage(state.filter(first <= F.col("_end")))
    if not found:
        found = [rows.select(key, "_pos").limit(0)]
    where = reduce(DataFrame.unionByName, found)
    out = rows.join(
        where.toDF("_k", "_p"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_pos") == F.col("_p"))
    )
    return cut_lineage(
        out.select(
            key, tie, F.timestamp_millis("_ms").alias(ts), F.col("_x").alias(value),
            F.col("_pos").alias("position"),
        )
    )


def _first_signals(live: DataFrame, near: DataFrame, key: str, key_type: str, p: Params, search: int) -> DataFrame:
    """Signals of every key in the ``search`` blocks of ``near`` from the first live one with any: (key, _pos)."""
    by_block = Window.partitionBy(key).orderBy("_block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        live.groupBy(key, "_block")
        .agg(F.count("*").alias("n"), F.sum("_x").alias("t"), F.min("_pos").alias("at"))
        .select(
            # New names: the rows and their totals are grouped together below.
            F.col(key).alias("_k"), F.col("_block").alias("_b"), "n", "at",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
            F.coalesce(F.sum("t").over(earlier), F.lit(0.0)).alias("t0"),
        )
    )

    def ends(group: tuple, x: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        v = x.sort_values("_pos")["_x"].to_numpy()
        up, down = _sums(v, int(info["n0"].iloc[0]), float(info["t0"].iloc[0]), 0.0, 0.0, p)
        info = info.rename(columns={"_k": key, "_b": "_block"})
        return info.assign(up=up[-1], down=down[-1])

    blocks = [F.col(key), F.col("_block")]
    partial = (
        live.groupBy(*blocks)
        .cogroup(totals.groupBy("_k", "_b"))
        .applyInPandas(
            ends,
            f"{key} {key_type}, _block bigint, n bigint, at bigint, n0 bigint, t0 double, up double, down double",
        )
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per block: the faded sums each block starts with."""
        pdf = pdf.sort_values("_block").reset_index(drop=True)
        power = p.fade ** pdf["n"].to_numpy(dtype=float)
        for name in ("up", "down"):
            start, values = 0.0, []
            for own, f in zip(pdf[name], power):
                values.append(start)
                start = f * start + own
            pdf[f"{name}0"] = values
        return pdf.drop(columns=["up", "down"])

    carried = partial.groupBy(key).applyInPandas(
        chain,
        f"{key} {key_type}, _block bigint, n bigint, at bigint, n0 bigint, t0 double, up0 double, down0 double",
    )

    def look(pdf: pd.DataFrame, info: pd.DataFrame):
        i = info.iloc[0]
        pdf = pdf.sort_values("_pos")
        up, down = _sums(
            pdf["_x"].to_numpy(), int(i.n0), float(i.t0), float(i.up0), float(i.down0), p
        )
        ripe = int(i.n0) + 1 + np.arange(len(up)) >= p.min_instances
        return pdf, up, down, ripe, i

    def extremes(group: tuple, x: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        _, up, down, ripe, i = look(x, info)
        rise = np.where(ripe, up - np.minimum.accumulate(up), -np.inf).max()
        fall = np.where(ripe, np.maximum.accumulate(down) - down, -np.inf).max()
        return info.assign(
            up_min=up.min(), down_max=down.max(), own=max(rise, fall),
            up_top=np.where(ripe, up, -np.inf).max(), down_low=np.where(ripe, down, np.inf).min(),
        )

    wide = (
        f"{key} {key_type}, _block bigint, n bigint, at bigint, n0 bigint, t0 double, up0 double, "
        "down0 double, up_min double, down_max double, own double, up_top double, down_low double"
    )
    judged = live.groupBy(*blocks).cogroup(carried.groupBy(*blocks)).applyInPandas(extremes, wide)
    judged = judged.withColumn("low", F.min("up_min").over(earlier)).withColumn(
        "high", F.max("down_max").over(earlier)
    )
    signal = (
        (F.col("own") > p.threshold)
        | (F.col("up_top") - F.col("low") > p.threshold)
        | (F.col("high") - F.col("down_low") > p.threshold)
    )
    # One row per key that signals; used twice below, so it is written down once.
    first = cut_lineage(
        judged.filter(F.coalesce(signal, F.lit(False)))
        .groupBy(key)
        .agg(F.min_by(F.struct("*"), "_block").alias("b"))
        .select("b.*")
        .withColumnsRenamed({key: "_k", "_block": "_b"})
    )

    def exact(group: tuple, x: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        """All signals from the block on: after each the detector restarts behind it."""
        x, i = x.sort_values("_pos"), info.iloc[0]
        low = np.inf if pd.isna(i.low) else float(i.low)
        high = -np.inf if pd.isna(i.high) else float(i.high)
        state = State(int(i.n0), float(i.t0), float(i.up0), float(i.down0), low, high)
        _, at = fold(state, x["_x"].to_numpy(), p)
        return pd.DataFrame({key: x[key].iloc[at], "_pos": x["_pos"].iloc[at]})

    # Only the stretches behind a signal go on.
    wanted = first.select(F.col("_k").alias("_wk"), F.col("_b").alias("_wb"), F.col("at").alias("_at"))
    searched = near.select(key, "_block", "_pos", "_x").join(
        wanted,
        F.col(key).eqNullSafe(F.col("_wk")) & (F.col("_pos") >= F.col("_at")) & (F.col("_block") < F.col("_wb") + search),
        "left_semi",
    )
    return (
        searched.groupBy(key)
        .cogroup(first.groupBy("_k"))
        .applyInPandas(exact, f"{key} {key_type}, _pos bigint")
    )
