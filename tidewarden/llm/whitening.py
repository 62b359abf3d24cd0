"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers (``floor(256 * c)``); the fit list is each distinct one once. Its centred
rows A = x - S/n are never gathered: a step multiplies them with the current right vector (A v) and
back (A^T u), each task sending sums of one row length only, combined by Spark before the driver
sees them. A left vector is kept as the combination of rows it is: u = A w, with w as short as a
row, so that full reorthogonalisation against all earlier left vectors is a sum over the same pass;
right vectors are reorthogonalised (twice) on the driver. The bidiagonal matrix, at most as large
as a row is long, then has its singular values and vectors taken: components and deviations.

``steps=None`` goes through all dimensions, which is exact also when eigenvalues coincide; fewer
steps approximate the leading components for very long vectors. A step that finds no new direction
restarts with another start vector, so constant or dependent dimensions do no harm. One pass per
step; the state on the driver is of the size of (dimensions x steps).

Sums S and the deviations are exact integers. Defined cases: rows whose vector is null, empty, or
holds null or non-finite entries are left out, and so are rows of another length than the most
frequent one (of equally frequent ones the shortest); repeated rows count once in the fit list and
come back each; a missing id stays missing; components without variance (fewer distinct vectors than
components, a fit list of one row) are not returned; a deviation beyond 2^63 - 1 is null; an empty
table gives an empty result; only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import read, written

SCALE = 256
COMPONENTS = 4
SEED = 20
TINY = 1e-12


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x (integers) of the rows that take part; written once."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    v = F.col(f"`{vector}`")
    good = table.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, entry))
    rows = written(good.select(F.col(f"`{key}`").alias("id"), integers(v).alias("x")), "whiten-rows")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    first = sizes.first()
    return rows.filter(F.size("x") == (first.d if first else 0))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(fit: DataFrame, task) -> dict[int, float]:
    """``task`` yields one vector of doubles per piece of rows; their sum over all tasks, by place."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = task(_matrix(batch))
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["at", "value"]
            )

    sums = fit.select("x").mapInArrow(parts, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    return {r.at: r.value for r in sums.collect()}


def _vector(sums: dict[int, float]) -> np.ndarray:
    return np.array([sums[i] for i in range(len(sums))])


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, S): rows of the fit list and their exact sums, as halves that cannot overflow."""
    low = (1 << 32) - 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                at = np.arange(x.shape[1])
                columns = [at, (x >> 32).sum(0), (x & low).sum(0), np.full(len(at), len(x))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "high", "low", "n"])

    sums = fit.select("x").mapInArrow(parts, "at long, high long, low long, n long").groupBy("at")
    found = sums.agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("at").collect()
    return (found[0].n if found else 0), [(r.high << 32) + r.low for r in found]


@dataclass(frozen=True)
class Whitening:
    """n, exact sums, mean, components (one per column), eigenvalues, trace of the covariance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def _start(d: int, basis: list[np.ndarray], draw: np.random.Generator) -> np.ndarray:
    while True:
        v = _orthogonal(draw.standard_normal(d), basis)
        if (norm := np.linalg.norm(v)) > 1e-6:
            return v / norm


def bidiagonalise(fit: DataFrame, mean: np.ndarray, steps: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with A V = U B: right vectors as columns, the upper bidiagonal matrix.

    ``size`` is the Frobenius norm of A; what is below ``TINY`` of it counts as zero.
    """
    d = len(mean)
    draw = np.random.default_rng(SEED)
    rights: list[np.ndarray] = [_start(d, [], draw)]
    shorts = np.zeros((d, 0))  # w of each left vector: u = A w
    backs = np.zeros((d, 0))  # A^T u of each left vector
    matrix = np.zeros((steps, steps))
    beta = 0.0
    for j in range(steps):
        w = rights[j] - (beta * shorts[:, j - 1] if j else 0.0)
        both = np.column_stack([shorts, w])

        def task(x: np.ndarray, both=both, mean=mean) -> np.ndarray:
            a = x - mean
            left = a @ both
            u = left[:, -1]
            return np.concatenate([left.T @ u, a.T @ u])

        sums = _vector(_sums(fit, task))
        along, square, back = sums[:j], sums[j], sums[j + 1 :]
        # What is left along earlier left vectors goes, for u, its norm and A^T u alike.
        w, back = w - shorts @ along, back - backs @ along
        alpha = np.sqrt(max(0.0, square - along @ along))
        if alpha <= TINY * size:
            alpha, w, back = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, back = w / alpha, back / alpha
        shorts, backs = np.column_stack([shorts, w]), np.column_stack([backs, back])
        matrix[j, j] = alpha
        if j + 1 == steps:
            break
        following = _orthogonal(back - alpha * rights[j], rights)
        beta = float(np.linalg.norm(following))
        if beta <= TINY * size:
            beta, following = 0.0, _start(d, rights, draw)
        else:
            following = following / beta
        rights.append(following)
        matrix[j, j + 1] = beta
    return np.column_stack(rights), matrix


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """Components of a fit list of distinct vectors ``x``; None when it is empty."""
    n, sums = totals(fit)
    if not n:
        return None
    d = len(sums)
    mean = np.array([s / n for s in sums])
    square = _vector(_sums(fit, lambda x: np.array([((x - mean) ** 2).sum()])))[0]
    right, matrix = bidiagonalise(fit, mean, min(d, steps or d), float(np.sqrt(square)))
    _, deviations, rows = np.linalg.svd(matrix)
    kept = deviations[:components] > TINY * 10 * np.sqrt(square)
    found = right @ rows.T[:, :components][:, kept]
    # One sign per component: its largest entry is positive.
    found = found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    return Whitening(n, sums, mean, found, deviations[:components][kept] ** 2 / n, square / n)


def _projection(w: Whitening) -> np.ndarray:
    return w.components / np.sqrt(w.values)


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""
    k = len(w.values)
    if not k:
        return 0.0
    to, mean = _projection(w), w.mean

    def task(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ to
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    sums = _vector(_sums(fit, task)) / w.n
    centre = sums[:k]
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(centre, centre) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over the dimensions of (n * x - S)^2 per row; None beyond a long."""
    most = max(n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)), 1)
    if most * most * len(sums) < 1 << 63:
        return ((n * x.astype("int64") - np.array(sums, "int64")) ** 2).sum(1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def apply(rows: DataFrame, w: Whitening) -> DataFrame:
    """id, component, deviation, whitened, explained of all rows (id, x)."""
    to, mean, n, sums = _projection(w), w.mean, w.n, w.sums
    k = len(w.values)
    share = (w.values / w.trace).tolist() if k else []
    kind = rows.schema["id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and k:
                x, m = _matrix(batch), batch.num_rows
                y = (x - mean) @ to
                at = np.repeat(np.arange(m), k)
                columns = [
                    batch.column("id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(at)),
                    pa.array(y.ravel(), pa.float64()),
                    pa.array(np.tile(share, m), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "deviation", "whitened", "explained"])

    return rows.select("id", "x").mapInArrow(
        project, f"id {kind}, component int, deviation long, whitened double, explained double"
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = usable(read(spark, sf_dir, "embeddings"))
    fit = written(rows.select("x").distinct(), "whiten-fit")
    w = fit_whitening(fit)
    if w is None:
        w = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    error = identity_error(fit, w)
    return apply(rows, w).select(
        F.col("id").alias("vec_id"), "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        "explained", F.lit(error).alias("identity_error"),
    )


# Iterative: compared with a dense eigendecomposition in the tests.
QUERIES = {"op13_embedding_whitening": query}
ORACLES = {}
