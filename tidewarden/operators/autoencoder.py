"""Autoencoder trained data-parallel, scored by reconstruction error.

The rows are dealt into a given number of parts, whatever their count. Each task streams
its part through mini-batch Adam, starting from the same weights; after every epoch the
results are averaged, weighted by rows. With one part this is plain mini-batch training.
With ``steps`` the parts only share the work: an epoch is that many steps of Adam, each on
the gradient over all rows of one slice, summed over tasks and up a tree, so the number of
parts changes nothing but rounding. Rows are dealt and sliced by a hash of their id, so
batches and slices mix all times and sources; a task holds one batch. Only weights reach the
driver, once per epoch or step, whatever the number of parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.arrays import matrix
from tidewarden.functions.quantiles import exact_percentile

HIDDEN = (512, 256, 128, 256, 512)
PARTS = 8
MERGE = 16


@dataclass
class Autoencoder:
    version: str
    sizes: list[int]
    weights: np.ndarray
    threshold: float = 0.0
    losses: list[float] = field(default_factory=list)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.sizes, self.weights.astype("<f8").tobytes(), float(self.threshold), self.losses)],
            "sizes array<int>, weights binary, threshold double, losses array<double>",
        )

    @classmethod
    def from_df(cls, df: DataFrame, version: str) -> Autoencoder:
        r = df.first()
        weights = np.frombuffer(bytes(r.weights), dtype="<f8").copy()
        return cls(version, list(r.sizes), weights, r.threshold, list(r.losses))


def shapes(sizes: list[int]) -> list[tuple[int, int]]:
    return list(zip(sizes[:-1], sizes[1:]))


def initial(sizes: list[int], seed: int) -> np.ndarray:
    """Uniform in +-1/sqrt(inputs) for weights and biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(sizes):
        bound = 1.0 / math.sqrt(a)
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def unpack(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes(sizes):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, layers: list) -> list[np.ndarray]:
    """Activations of every layer; ReLU on all but the last."""
    acts = [x]
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
    return acts


def gradient(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, float]:
    """Gradient and value of the mean squared error of one batch."""
    layers = unpack(flat, sizes)
    acts = forward(x, layers)
    diff = acts[-1] - x
    loss = float(np.mean(diff * diff))
    back = 2.0 * diff / diff.size
    grads: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        grads += [back.sum(axis=0), (acts[i].T @ back).ravel()]
        if i:
            back = (back @ layers[i][0].T) * (acts[i] > 0)
    return np.concatenate(grads[::-1]), loss


def errors(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    out = forward(x, unpack(flat, sizes))[-1]
    return np.mean((out - x) ** 2, axis=1)


def mini_batches(arrays: Iterator[np.ndarray], batch: int) -> Iterator[np.ndarray]:
    """Runs of ``batch`` rows; the last may be shorter."""
    held: list[np.ndarray] = []
    rows = 0
    for x in arrays:
        while len(x):
            part, x = x[: batch - rows], x[batch - rows :]
            held.append(part)
            rows += len(part)
            if rows == batch:
                yield np.concatenate(held)
                held, rows = [], 0
    if held:
        yield np.concatenate(held)


def adam(
    w: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, step: int, lr: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and both moments after step number ``step``, counted from 1."""
    m = 0.9 * m + 0.1 * g
    v = 0.999 * v + 0.001 * g * g
    return w - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8), m, v


def train_part(
    arrays: Iterator[np.ndarray], state: np.ndarray, step: int, sizes: list[int], lr: float, batch: int
) -> tuple[np.ndarray, float, int, int]:
    """One epoch of Adam: (weights and both moment rows, mean loss, rows, steps)."""
    w, m, v = state[0].copy(), state[1].copy(), state[2].copy()
    first, total, rows = step, 0.0, 0
    for x in mini_batches(arrays, batch):
        step += 1
        g, loss = gradient(x, w, sizes)
        w, m, v = adam(w, m, v, g, step, lr)
        total, rows = total + loss, rows + len(x)
    return np.stack([w, m, v]), total / max(step - first, 1), rows, step - first


def mean_gradient(
    arrays: Iterator[np.ndarray], weights: np.ndarray, sizes: list[int], batch: int
) -> tuple[np.ndarray, float, int]:
    """(mean gradient, mean loss, rows) over all rows at the same weights, a batch at a time."""
    total, loss, rows = np.zeros_like(weights), 0.0, 0
    for x in mini_batches(arrays, batch):
        g, own = gradient(x, weights, sizes)
        total, loss, rows = total + g * len(x), loss + own * len(x), rows + len(x)
    return total / max(rows, 1), loss / max(rows, 1), rows


PART = "part bigint, rows bigint, steps bigint, loss double, state binary"


def _average(pdf: pd.DataFrame) -> tuple[int, float, np.ndarray]:
    rows = pdf["rows"].to_numpy(dtype=float)
    share = rows / rows.sum()
    state = sum(s * np.frombuffer(b, dtype="<f8") for s, b in zip(share, pdf["state"]))
    return int(rows.sum()), float((pdf["loss"] * share).sum()), state


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    rows, loss, state = _average(pdf.sort_values("part"))
    return pd.DataFrame(
        {"part": [int(pdf["part"].min()) // MERGE], "rows": [rows], "steps": [pdf["steps"].max()],
         "loss": [loss], "state": [state.astype("<f8").tobytes()]}
    )


def _meet(trained: DataFrame, parts: int) -> pd.DataFrame:
    """Rows of ``PART`` merged up a tree to the one that the driver gets, none without rows."""
    while parts > 1:
        trained = trained.groupBy(F.floor(F.col("part") / MERGE)).applyInPandas(_merge, PART)
        parts = math.ceil(parts / MERGE)
    return trained.toPandas()


def _part(rows: int, steps: int, loss: float, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": [TaskContext.get().partitionId()], "rows": [rows], "steps": [steps], "loss": [loss],
         "state": [state.astype("<f8").tobytes()]}
    )


def _averaged_epoch(
    data: DataFrame, state: np.ndarray, step: int, sizes: list[int], lr: float, batch: int, parts: int
) -> tuple[np.ndarray, float, int]:
    """Every part through Adam on its own, then the mean of their states."""
    shared = data.sparkSession.sparkContext.broadcast(state)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = (matrix(b.column("x")) for b in batches if b.num_rows)
        new, loss, rows, steps = train_part(arrays, shared.value, step, sizes, lr, batch)
        if rows:
            yield _part(rows, steps, loss, new)

    last = _meet(data.select("x").mapInArrow(train, PART), parts)
    shared.unpersist()
    if last.empty:
        raise ValueError("no rows to train on")
    _, loss, flat = _average(last)
    return flat.reshape(3, -1), loss, step + int(last["steps"].max())


def _summed_epoch(
    data: DataFrame, state: np.ndarray, step: int, sizes: list[int], lr: float, batch: int, parts: int,
    order: np.ndarray,
) -> tuple[np.ndarray, float, int]:
    """A step of Adam per slice, on the gradient over all rows of the slice."""
    w, m, v = state
    total, rows = 0.0, 0
    for piece in order:
        shared = data.sparkSession.sparkContext.broadcast(w)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            arrays = (matrix(b.column("x")) for b in batches if b.num_rows)
            g, loss, n = mean_gradient(arrays, shared.value, sizes, batch)
            if n:
                yield _part(n, 1, loss, g)

        last = _meet(data.filter(F.col("slice") == int(piece)).select("x").mapInArrow(sums, PART), parts)
        shared.unpersist()
        if last.empty:  # no id falls into this slice
            continue
        n, loss, g = _average(last)
        step += 1
        w, m, v = adam(w, m, v, g, step, lr)
        total, rows = total + loss * n, rows + n
    if not rows:
        raise ValueError("no rows to train on")
    return np.stack([w, m, v]), total / rows, step


def fit(
    df: DataFrame,
    vector: str,
    row_id: str,
    width: int,
    version: str = "ae-v1",
    hidden: tuple[int, ...] = HIDDEN,
    epochs: int = 50,
    lr: float = 1e-3,
    batch: int = 256,
    patience: int = 5,
    seed: int = 42,
    threshold: str = "sigma",
    parts: int = PARTS,
    steps: int | None = None,
) -> Autoencoder:
    """Train until the epoch loss has not improved for ``patience`` epochs.

    ``threshold``: ``sigma`` for mean + 3 deviations of the training errors,
    ``p95`` for their 95th percentile. ``parts`` is the number of tasks. ``steps``: steps of
    an epoch that are taken on summed gradients; the model is then the same for any ``parts``
    but for rounding (a job per step, so this is for many rows to a step). None: parts train
    on their own and are averaged, so their number changes the curve.
    """
    sizes = [width, *hidden, width]
    data = (
        df.select(F.col(row_id).cast("string").alias("id"), F.col(vector).alias("x"))
        .withColumn("h", F.xxhash64("id", F.lit(seed)))
        .withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(steps or 1)))
        .repartition(parts, "h")
        # Slices lie together, so a step reads the cached blocks of its own.
        .sortWithinPartitions("slice", "h", "id")
        .select("slice", "x")
        .persist()
    )
    weights = initial(sizes, seed)
    state = np.stack([weights, np.zeros_like(weights), np.zeros_like(weights)])
    best, waited, losses, step = math.inf, 0, [], 0
    try:
        for epoch in range(epochs):
            if steps:
                order = np.random.default_rng([seed, epoch]).permutation(steps)
                state, loss, step = _summed_epoch(data, state, step, sizes, lr, batch, parts, order)
            else:
                state, loss, step = _averaged_epoch(data, state, step, sizes, lr, batch, parts)
            losses.append(loss)
            if loss < best:
                best, waited = loss, 0
            else:
                waited += 1
            if waited >= patience:
                break
        model = Autoencoder(version, sizes, state[0], 0.0, losses)
        err = data.select(error_column(model, F.col("x")).alias("e"))
        if threshold == "p95":
            model.threshold = exact_percentile(err, "e", 0.95)
        else:
            model.threshold = err.agg(F.avg("e") + 3 * F.stddev_pop("e")).first()[0]
        return model
    finally:
        data.unpersist()


def error_column(model: Autoencoder, vector: Column) -> Column:
    """Reconstruction error per row."""
    shared = SparkSession.active().sparkContext.broadcast((model.weights, list(model.sizes)))

    @F.arrow_udf("double")
    def error(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, sizes = shared.value
        for vectors in batches:
            x = matrix(vectors)
            yield pa.array(errors(x, weights, sizes) if len(x) else np.zeros(0))

    return error(vector)


def score(df: DataFrame, model: Autoencoder, vector: str) -> DataFrame:
    """Adds ``score`` (reconstruction error) and ``is_anomaly`` (above the threshold)."""
    scored = df.withColumn("score", error_column(model, F.col(vector)))
    return scored.withColumn("is_anomaly", F.col("score") > F.lit(model.threshold))
