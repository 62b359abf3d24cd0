"""Language identification by rank-order profiles (out-of-place distance).

Letters are lower-cased and runs of other characters become one blank; n-grams of one to three
characters that do not cross a blank are counted, blanks at word ends included. A language's
profile holds its ``TOP`` most frequent n-grams in order; so does a document's. The distance adds
up how far each of the document's n-grams is out of place in the language's profile, ``TOP`` for
one that is not there, and the nearest language wins.

The score is 1 minus the distance's share of the largest distance possible. Ties go by code point
of the n-gram or the language. Defined cases: ``und`` with score 0 if the text is null or has no
letter, or if no language was learned; null languages are not learned from; repeated rows get
equal rows; an empty table gives an empty result; other columns are not read. The profiles sent
to the tasks have ``TOP`` entries per language, at most ``MOST_LANGUAGES`` languages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.llm.common import fold, pieces, read, text_of

TOP = 300
MOST_LANGUAGES = 5_000
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of every text, n-grams as numbers in ascending order."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    size = pc.utf8_length(low).to_numpy()
    points = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), "<u4").astype("int64")
    limits = np.concatenate([[0], size.cumsum()])
    is_letter = letters()[points]
    # A blank closes every text; blanks after blanks go.
    points = np.insert(np.where(is_letter, points, 32), limits[1:], 32)
    limits = limits + np.arange(len(limits))
    blank = points == 32
    first = np.zeros(len(points), bool)
    first[limits[:-1]] = True
    before = np.concatenate([[True], blank[:-1]]) | first
    kept = ~(blank & before)
    limits = np.concatenate([[0], kept.cumsum()])[limits]
    x = points[kept]
    for a, b in zip(limits[:-1], limits[1:]):
        w = np.concatenate([[32], x[a:b]]) if b > a else x[a:b]
        inner = w != 32
        two = (w[:-1] << 42 | w[1:] << 21)[inner[:-1] | inner[1:]]
        three = (w[:-2] << 42 | w[1:-1] << 21 | w[2:])[inner[1:-1]]
        found = np.sort(np.concatenate([w[inner] << 42, two, three]))
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, int)
        yield found[starts], np.diff(np.append(starts, len(found)))


def profiles(docs: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """The ``top`` n-grams of every language, most frequent first, from columns lang and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, n = (np.concatenate(x) for x in zip(*parts))
            codes, at = np.unique(codes, return_inverse=True)
            return codes, np.bincount(at, n, minlength=len(codes)).astype("int64")

        for part in pieces(batches, "text"):
            for lang, found in zip(part.column("lang").to_pylist(), grams(part.column("text"))):
                held.setdefault(lang, []).append(found)
            held = {lang: [merged(parts)] for lang, parts in held.items()}
        for lang, parts in held.items():
            for codes, n in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"]
                )

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.select("lang", "gram", F.row_number().over(ranked).alias("rank")).filter(F.col("rank") <= top)
    rows = best.limit(MOST_LANGUAGES * top + 1).collect()
    if len(rows) > MOST_LANGUAGES * top:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(codes, "int64") for lang, codes in out.items()}


class Ranks:
    """Rank of every profile n-gram in every language, ``top`` where it has none."""

    def __init__(self, learned: dict[str, np.ndarray], top: int):
        self.names, self.top = sorted(learned), top
        self.codes = np.unique(np.concatenate([np.zeros(0, "int64"), *learned.values()]))
        self.rank = np.full((len(self.names), len(self.codes) + 1), top, "int32")
        for k, name in enumerate(self.names):
            self.rank[k, np.searchsorted(self.codes, learned[name])] = np.arange(len(learned[name]))

    def nearest(self, codes: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        """Nearest language to the n-grams of a text and its score."""
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = codes[np.argsort(-n, kind="stable")[: self.top]]
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        rank = self.rank[:, at]
        away = np.where(rank < self.top, np.abs(rank - np.arange(len(own))), self.top).sum(axis=1)
        best = int(away.argmin())
        return self.names[best], 1.0 - float(away[best]) / (self.top * len(own))


def identify(docs: DataFrame, learned: dict[str, np.ndarray], held_out: Column, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(Ranks(learned, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = [sent.value.nearest(*x) for x in grams(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array([x for x, _ in found], pa.string()),
                 pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out.alias("held_out"), text_of("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold("doc_id", FOLDS) == HELD_OUT
    learned = profiles(docs.filter(~held & F.col("lang").isNotNull()))
    return identify(docs, learned, held)


QUERIES = {"op4_language_id": query}
ORACLES: dict[str, str] = {}
