"""Online half-space trees with a running scaler in front: score, then learn.

Tan, Ting and Liu (2011): random trees are fixed before any data is seen; only
the counts in their nodes change. Rows are counted over windows of 250, and a row
is scored against the counts of the previous window.

That makes the method splittable. The scaler state before a row is a running sum,
and inside a window nothing depends on the order of the rows, so any window can
be worked on by itself given its predecessor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.operators.ordered import with_prefix
from tidewarden.session import cut_lineage

PADDING = 0.15
SENT_KEYS = 100_000  # keys whose two numbers are sent to all tasks; more are joined


@dataclass(frozen=True)
class Params:
    trees: int = 25
    height: int = 8
    window: int = 250
    seed: int = 42

    @property
    def nodes(self) -> int:
        return 2 ** (self.height + 1) - 1

    @property
    def low_mass(self) -> float:
        """Below this count the descent stops."""
        return 0.1 * self.window

    @property
    def top_score(self) -> float:
        return self.trees * self.window * (2 ** (self.height + 1) - 1)


def grow(width: int, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of every inner node, [tree, node]; children of i: 2i+1, 2i+2.

    Each feature ranges over 0..1. A node picks a feature with a chance in
    proportion to the width it has left there and cuts it away from the edges.
    """
    inner = 2**params.height - 1
    feature = np.zeros((params.trees, inner), dtype=np.int64)
    cut = np.zeros((params.trees, inner))
    for t in range(params.trees):
        rng = np.random.default_rng([params.seed, t, width])
        low, high = {0: np.zeros(width)}, {0: np.ones(width)}
        for node in range(inner):
            a, b = low.pop(node), high.pop(node)
            f = int(rng.choice(width, p=(b - a) / (b - a).sum()))
            gap = PADDING * (b[f] - a[f])
            at = float(rng.uniform(a[f] + gap, b[f] - gap))
            feature[t, node], cut[t, node] = f, at
            left, right = 2 * node + 1, 2 * node + 2
            low[left], high[left] = a, b.copy()
            high[left][f] = at
            low[right], high[right] = a.copy(), b
            low[right][f] = at
    return feature, cut


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, height: int) -> np.ndarray:
    """Nodes visited, [row, tree, level], root first."""
    n, trees = len(x), len(feature)
    path = np.zeros((n, trees, height + 1), dtype=np.int64)
    rows = np.arange(n)
    for t in range(trees):
        at = np.zeros(n, dtype=np.int64)
        for level in range(height):
            at = 2 * at + 1 + (x[rows, feature[t][at]] >= cut[t][at])
            path[:, t, level + 1] = at
    return path


def masses(path: np.ndarray, params: Params) -> np.ndarray:
    """Rows that passed each node, [tree, node]."""
    out = np.zeros((params.trees, params.nodes))
    for t in range(params.trees):
        out[t] = np.bincount(path[:, t, :].ravel(), minlength=params.nodes)
    return out


def score(path: np.ndarray, reference: np.ndarray, params: Params) -> np.ndarray:
    """1 - (sum of mass x 2^depth down to the first sparse node) / largest possible."""
    mass = np.stack([reference[t][path[:, t, :]] for t in range(params.trees)], axis=1)
    sparse = mass < params.low_mass
    # A node counts while no node above it was sparse.
    seen = np.cumsum(sparse, axis=2) - sparse == 0
    weight = 2.0 ** np.arange(params.height + 1)
    return 1.0 - (mass * seen * weight).sum(axis=(1, 2)) / params.top_score


def standardise(x: np.ndarray, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """(x - mean) / deviation from counts and sums; 0 where there is no spread."""
    count = np.maximum(n, 1)[:, None]
    mean = s1 / count
    var = np.maximum(s2 / count - mean * mean, 0.0)
    usable = (var > 0) & (n[:, None] > 0)
    return np.where(usable, (x - mean) / np.sqrt(np.where(usable, var, 1.0)), 0.0)


# --- one key after another: the streaming form -----------------------------------


@dataclass
class State:
    """What is kept per key between micro-batches."""

    n: int
    centre: np.ndarray
    s1: np.ndarray
    s2: np.ndarray
    current: np.ndarray
    reference: np.ndarray

    @classmethod
    def start(cls, first: np.ndarray, params: Params) -> State:
        zero = np.zeros(len(first))
        empty = np.zeros((params.trees, params.nodes))
        return cls(0, first.astype(float), zero, zero.copy(), empty, empty.copy())


def fold(
    state: State, x: np.ndarray, trees: tuple[np.ndarray, np.ndarray], params: Params
) -> np.ndarray:
    """Scores of the rows in order; the state moves along."""
    out = np.zeros(len(x))
    d_all = x - state.centre
    start = 0
    while start < len(x):
        room = params.window - state.n % params.window
        d = d_all[start : start + room]
        n = state.n + np.arange(len(d))
        s1 = state.s1 + np.cumsum(d, axis=0)
        s2 = state.s2 + np.cumsum(d * d, axis=0)
        if state.n >= params.window:
            before = standardise(
                d, n, np.vstack([state.s1, s1[:-1]]), np.vstack([state.s2, s2[:-1]])
            )
            out[start : start + len(d)] = score(
                walk(before, *trees, params.height), state.reference, params
            )
        after = standardise(d, n + 1, s1, s2)
        state.current += masses(walk(after, *trees, params.height), params)
        state.n += len(d)
        state.s1, state.s2 = s1[-1], s2[-1]
        if state.n % params.window == 0:
            state.reference, state.current = state.current, np.zeros_like(state.current)
        start += len(d)
    return out


# --- all keys at once: the batch form ----------------------------------------------

# What a key carries from one part of its rows to the next; counts and sums, which add.
STATE = "key string, n bigint, centre array<double>, s1 array<double>, s2 array<double>, current binary, reference binary"


def batch_scores(
    df: DataFrame,
    key: str,
    vector: str,
    width: int,
    ts: str = "event_time",
    tie: str = "event_id",
    params: Params = Params(),
    chunk_ms: int = 300_000,
    windows_per_task: int = 64,
    given: tuple[np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """(key, tie, position, score) for every row, equal to folding each key in order.

    Rows are numbered and the scaler sums are accumulated without gathering a
    key. A task then gets ``windows_per_task`` windows and the one before them,
    i.e. a fixed number of rows however large the key is. ``given`` are trees in place of grown ones.
    """
    base = df.select(key, tie, F.unix_millis(ts).alias("_ms"), F.col(vector).alias("_x"))
    centre = base.groupBy(key).agg(F.min_by("_x", F.struct("_ms", tie)).alias("_c"))
    rows = _numbered(base.join(centre, key), key, tie, width, chunk_ms)
    blocks = _blocks(F.floor(F.col("_pos") / params.window), windows_per_task)
    arrays = rows.select(key, tie, "_pos", "d", "s1", "s2", F.explode(blocks).alias("_block"))
    types = dict(df.dtypes)
    trees = given or grow(width, params)

    def one_block(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _block_scores(pdf, key, tie, group[1], windows_per_task, trees, params, {})

    return arrays.groupBy(key, "_block").applyInPandas(
        one_block, f"{key} {types[key]}, {tie} {types[tie]}, position bigint, score double"
    )


def _numbered(base: DataFrame, key: str, tie: str, width: int, chunk_ms: int) -> DataFrame:
    """Rows (key, tie, _ms, _x, _c) with _pos, the distances d and their sums s1, s2 before the row."""
    sums = {}
    for i in range(width):
        base = base.withColumn(f"_d{i}", F.get("_x", F.lit(i)) - F.get("_c", F.lit(i)))
        sums[f"s1_{i}"] = F.col(f"_d{i}")
        sums[f"s2_{i}"] = F.col(f"_d{i}") * F.col(f"_d{i}")
    rows = with_prefix(base.drop("_x", "_c"), key, "_ms", tie, sums, chunk_ms)
    arrays = {"d": "_d{}", "s1": "s1_{}", "s2": "s2_{}"}
    kept = [c for c in rows.columns if not any(c == f.format(i) for f in arrays.values() for i in range(width))]
    return rows.select(*kept, *[F.array(*[f.format(i) for i in range(width)]).alias(n) for n, f in arrays.items()])


def _blocks(slot: Column, windows_per_task: int) -> Column:
    """The block of a window, and the next one for a block's last window, which is its reference."""
    block = lambda s: F.floor(s / F.lit(windows_per_task))
    own, following = block(slot), block(slot + 1)
    return F.when(own != following, F.array(own, following)).otherwise(F.array(own))


def _block_scores(
    pdf: pd.DataFrame, key: str, tie: str, block: int, windows_per_task: int,
    trees: tuple[np.ndarray, np.ndarray], params: Params, held: dict[int, np.ndarray],
) -> pd.DataFrame:
    """Scores of the rows of a block; ``held``: masses that windows have from earlier rows."""
    pdf = pdf.sort_values("_pos")
    pos = pdf["_pos"].to_numpy()
    d, s1, s2 = (np.vstack(pdf[c].to_numpy()).astype(float) for c in ("d", "s1", "s2"))
    after = walk(standardise(d, pos + 1, s1 + d, s2 + d * d), *trees, params.height)
    before = walk(standardise(d, pos, s1, s2), *trees, params.height)
    slots = pos // params.window
    result = np.zeros(len(pdf))
    for w in np.unique(slots):
        ahead = slots == w
        reference = slots == w - 1
        if w > 0 and (reference.any() or w - 1 in held):
            mass = masses(after[reference], params) + held.get(w - 1, 0.0)
            result[ahead] = score(before[ahead], mass, params)
    mine = slots // windows_per_task == block
    return pd.DataFrame(
        {key: pdf[key][mine], tie: pdf[tie][mine], "position": pos[mine], "score": result[mine]}
    )


def continued(
    df: DataFrame,
    key: str,
    vector: str,
    width: int,
    state: DataFrame,
    ts: str = "event_time",
    tie: str = "event_id",
    params: Params = Params(),
    chunk_ms: int = 300_000,
    windows_per_task: int = 64,
    given: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scores, state behind the rows) of rows that follow those which left ``state``.

    Like ``batch_scores``, but numbers, sums and the two youngest windows start from the state. The
    new state needs the sums of the rows, and of rows only those in a key's last two windows.
    """
    trees, shape = given or grow(width, params), (params.trees, params.nodes)
    types = dict(df.dtypes)
    base = df.select(key, tie, F.unix_millis(ts).alias("_ms"), F.col(vector).alias("_x"))
    old = state.select(
        F.col("key").alias("_k"), F.col("n").alias("_n0"), F.col("centre").alias("_c0"), F.col("s1").alias("_s10"),
        F.col("s2").alias("_s20"), "current", "reference",
    )
    # One row per key of the batch: what it starts from.
    zeros = F.array(*[F.lit(0.0)] * width)
    starts = base.groupBy(F.col(key).alias("_key")).agg(F.min_by("_x", F.struct("_ms", tie)).alias("_first"))
    starts = starts.join(old, F.col("_key").eqNullSafe(F.col("_k")), "left").select(
        "_key", F.coalesce("_n0", F.lit(0)).alias("_n0"), F.coalesce("_c0", "_first").alias("_c"),
        F.coalesce("_s10", zeros).alias("_s10"), F.coalesce("_s20", zeros).alias("_s20"), "current", "reference",
    )
    starts = cut_lineage(starts)
    begun = base.join(starts.drop("current", "reference"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    rows = _numbered(begun, key, tie, width, chunk_ms)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    rows = rows.select(
        key, tie, (F.col("_pos") + F.col("_n0")).alias("_pos"), "d", add("s1", "_s10").alias("s1"), add("s2", "_s20").alias("s2")
    )
    slot = F.floor(F.col("_pos") / params.window)
    arrays = rows.select("*", F.explode(_blocks(slot, windows_per_task)).alias("_block"))
    # The masses so far go to the block of the window the key stands in, and to the next one.
    stands = F.floor(F.col("_n0") / params.window)
    near = starts.filter("current is not null").select(
        "_key", "_n0", "current", "reference", F.explode(_blocks(stands, windows_per_task)).alias("_b")
    )

    def read(raw: bytes) -> np.ndarray:
        return np.frombuffer(bytes(raw), "<i4").reshape(shape).astype(float)

    def one_block(group: tuple, pdf: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[key, tie, "position", "score"])
        held = {}
        for _, r in info.iterrows():
            w = int(info["_n0"].iloc[0]) // params.window
            held = {w: read(r["current"]), w - 1: read(r["reference"])}
        return _block_scores(pdf, key, tie, group[1], windows_per_task, trees, params, held)

    scored = (
        arrays.groupBy(key, "_block")
        .cogroup(near.groupBy("_key", "_b"))
        .applyInPandas(one_block, f"{key} {types[key]}, {tie} {types[tie]}, position bigint, score double")
    )
    # The state behind the rows.
    total = lambda name, power: F.array(*[F.sum(F.pow(F.get("d", F.lit(i)), F.lit(power))).alias(f"{name}{i}") for i in range(width)])
    ends = rows.groupBy(F.col(key).alias("_ek")).agg(F.count("*").alias("_m"), total("a", 1).alias("_t1"), total("b", 2).alias("_t2"))
    ends = starts.join(ends, F.col("_key").eqNullSafe(F.col("_ek"))).select(
        "_key", "_n0", (F.col("_n0") + F.col("_m")).alias("_n1"), "_c", add("_s10", "_t1").alias("_s1"),
        add("_s20", "_t2").alias("_s2"), "current", "reference",
    )
    ends = cut_lineage(ends)
    last = ends.select(F.col("_key").alias("_lk"), F.floor(F.col("_n1") / params.window).alias("_last"))
    young = rows.join(F.broadcast(last) if last.count() <= SENT_KEYS else last, F.col(key).eqNullSafe(F.col("_lk")))
    young = young.filter(slot >= F.col("_last") - 1).select("_lk", "_pos", "d", "s1", "s2")

    def leave(group: tuple, pdf: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        r = info.iloc[0]
        w0, w1 = int(r["_n0"]) // params.window, int(r["_n1"]) // params.window
        held = {w0: read(r["current"]), w0 - 1: read(r["reference"])} if r["current"] is not None else {}
        path, slots = None, np.zeros(0, int)
        if len(pdf):
            pos = pdf["_pos"].to_numpy()
            d, s1, s2 = (np.vstack(pdf[c].to_numpy()).astype(float) for c in ("d", "s1", "s2"))
            path, slots = walk(standardise(d, pos + 1, s1 + d, s2 + d * d), *trees, params.height), pos // params.window
        out = []
        for w in (w1, w1 - 1):
            mass = held.get(w, np.zeros(shape))
            if (slots == w).any():
                mass = mass + masses(path[slots == w], params)
            out.append(mass.astype("<i4").tobytes())
        return pd.DataFrame(
            {"key": [group[0]], "n": [int(r["_n1"])], "centre": [r["_c"]], "s1": [r["_s1"]], "s2": [r["_s2"]],
             "current": [out[0]], "reference": [out[1]]}
        )

    moved = young.groupBy("_lk").cogroup(ends.groupBy("_key")).applyInPandas(leave, STATE)
    idle = state.join(ends.select(F.col("_key").alias("_ik")), F.col("key").eqNullSafe(F.col("_ik")), "left_anti")
    return scored, idle.unionByName(moved)
