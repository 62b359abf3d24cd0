"""Quality scores by regularised quadratic discriminant analysis.

Every text becomes a vector of transformed statistics: logs of lengths, square roots of shares.
Each class of labelled rows gives a mean and a covariance; a covariance is shrunk towards the
pooled one and its diagonal, so that few rows still give an invertible matrix. The score is the
logistic function of the difference of the two Gaussian log densities (Mahalanobis distances by
cached Cholesky factors) plus the log odds of the classes.

The fit needs counts, sums and products of features only: tasks send those, not rows.
Statistics are computed once per text and written, then joined with the labels.

Defined cases: a null or empty text has statistics like any other and gets a score; null labels
are not learned from; a document with several labels counts with each; with no labelled row of
one class every score is the smoothed share of class 1; repeated rows get equal rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import flat_bytes, fold, per_row, pieces, read, split_words, text_of, written

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
POOLED, DIAGONAL, FLOOR = 0.1, 0.1, 1e-3
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "sign", "other")


def _byte_class() -> np.ndarray:
    """Class of a UTF-8 byte; bytes that continue a character have none."""
    out = np.full(256, 6, "int8")  # signs
    out[[*range(97, 123)]], out[[*range(65, 91)]], out[[*range(48, 58)]] = 0, 1, 2
    out[[32, 9, 11, 12, 13]], out[10] = 3, 4
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 5
    out[128:192], out[192:] = -1, 7
    return out


BYTE_CLASS = _byte_class()


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every bit of the result depends on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    texts = texts.fill_null("")
    raw, limits = flat_bytes(texts)
    size = np.diff(limits)
    kind = BYTE_CLASS[raw]
    n = {name: per_row((kind == k).astype("int64"), size) for k, name in enumerate(CLASSES)}
    chars = sum(n.values())
    visible = np.maximum(1, chars - n["blank"] - n["line"])
    words, codes, distinct = split_words(texts)
    many = np.maximum(1, words)
    owner = np.repeat(np.arange(len(words)), words)
    length = np.diff(flat_bytes(distinct)[1])[codes].astype("float64")
    mean = per_row(length, words) / many
    spread = np.sqrt(np.maximum(0, per_row(length**2, words) / many - mean**2))
    same = np.zeros(len(codes), "int64")  # words equal to the word before
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    pairs = np.unique(owner * max(1, len(distinct)) + codes)
    types = np.bincount(pairs // max(1, len(distinct)), minlength=len(words))
    # Three-word windows that the text already had. Words count by content, so a text's numbers do
    # not depend on the texts around it; the mixing keeps different windows apart.
    h = pd.util.hash_array(np.array(distinct.to_pylist(), object), categorize=False)[codes]
    key = _mixed(_mixed(_mixed(h[:-2]) + h[1:-1]) + h[2:]) if len(h) > 2 else h[:0]
    inside = owner[2:] == owner[:-2]
    at, key = owner[2:][inside], key[inside]
    order = np.lexsort((key, at))
    at, key = at[order], key[order]
    again = np.zeros(len(at), bool)
    again[1:] = (at[1:] == at[:-1]) & (key[1:] == key[:-1])
    repeats = np.bincount(at[again], minlength=len(words))
    share = lambda x, y: np.sqrt(x / np.maximum(1, y))
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.log1p(spread),
            share(n["upper"], visible),
            share(n["digit"], visible),
            share(n["stop"], visible),
            share(n["sign"], visible),
            share(n["other"], visible),
            share(n["line"], many),
            share(types, many),
            share(per_row(same, words), many),
            share(repeats, many),
        ]
    ).astype("float64")


WIDTH = 12


class Discriminant:
    """Two Gaussian classes: means, Cholesky factors and log determinants are computed once."""

    def __init__(self, n: np.ndarray, total: np.ndarray, products: np.ndarray):
        self.prior = float((n[1] + 1) / (n.sum() + 2))
        self.fitted = bool(n.min() > 0)
        if not self.fitted:
            return
        mean = total / n[:, None]
        within = [products[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
        pooled = (n[0] * within[0] + n[1] * within[1]) / n.sum()
        self.scale = np.sqrt(np.diag(pooled) + FLOOR)
        self.mean, self.inverse, self.logdet = mean / self.scale, [], []
        pooled = pooled / np.outer(self.scale, self.scale)
        for k in (0, 1):
            own = within[k] / np.outer(self.scale, self.scale)
            s = (1 - POOLED - DIAGONAL) * own + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled))
            factor = np.linalg.cholesky(s + FLOOR * np.eye(len(s)))
            self.inverse.append(np.linalg.inv(factor))
            self.logdet.append(2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.fitted:
            return np.full(len(x), self.prior)
        density = []
        for k in (0, 1):
            away = (x / self.scale - self.mean[k]) @ self.inverse[k].T
            density.append(-0.5 * ((away**2).sum(axis=1) + self.logdet[k]))
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """From rows doc_id, features and the labels of those documents."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = np.zeros(2), np.zeros((2, WIDTH)), np.zeros((2, WIDTH, WIDTH))
        for b in batches:
            y = b.column("label").to_numpy()
            x = b.column("features").flatten().to_numpy().reshape(-1, WIDTH)
            for k in (0, 1):
                part = x[y == k]
                n[k] += len(part)
                total[k] += part.sum(axis=0)
                products[k] += part.T @ part
        flat = np.concatenate([n, total.ravel(), products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    y = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    known = features.join(y, F.col("doc_id") == F.col("_id")).select("label", "features")
    rows = known.mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + 2 * WIDTH + 2 * WIDTH * WIDTH)
    for r in rows:
        flat[r.k] = r.v
    a, b = 2, 2 + 2 * WIDTH
    return Discriminant(flat[:a], flat[a:b].reshape(2, WIDTH), flat[b:].reshape(2, WIDTH, WIDTH))


def featurise(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, features of every row; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", 4 << 20):
            x = statistics(part.column("text"))
            rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype="int32") * WIDTH, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), rows], names=["doc_id", "held_out", "features"]
            )

    rows = docs.select("doc_id", held_out.alias("held_out"), text_of("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, features array<double>")


def classify(features: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column("features").flatten().to_numpy().reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype("int32"))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    features = written(featurise(docs, fold("doc_id", FOLDS) == HELD_OUT), "quality-features")
    return classify(features, fit(features.filter("not held_out"), labels))


QUERIES = {"op5_quality_classifier": query}
ORACLES: dict[str, str] = {}
