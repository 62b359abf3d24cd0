"""What the corpus operators share: reading tables, words, hash folds, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.session import configure, shared_dir
from tidewarden.sources import files

# ASCII white space separates words; every other character belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by any path that Spark can open."""
    configure(spark)
    # Texts may be long: small Arrow batches bound the memory of a Python worker.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; a missing one is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, GAP), "")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    Later jobs read the files, so a lost executor costs a re-read and nothing is computed twice.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a working folder that no later job reads."""
    files.delete(spark, path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, at least one row each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size.astype("int64")) - size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """All rows in pieces of about ``most`` bytes of text: small batches together, large ones cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, column, most):
            held.append(part)
            size += part.column(column).nbytes
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words per text, code of every word in order, the distinct words) of a piece of a table."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy())
    kept = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not kept.all():  # the empty pieces at both ends of a text
        row = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(row[kept], minlength=len(counts))
        flat = flat.filter(pa.array(kept))
    coded = flat.dictionary_encode()
    return counts.astype("int64"), coded.indices.to_numpy().astype("int64"), coded.dictionary


def per_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values; a run of none gives 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def flat_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after the other, and the limits of each."""
    words = pa.array(words, pa.large_string()) if not pa.types.is_large_string(words.type) else words
    words = pa.concat_arrays([words])
    limits = np.frombuffer(words.buffers()[1], "int64")[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    raw = np.frombuffer(data, "uint8") if data is not None and data.size else np.zeros(0, "uint8")
    return raw[limits[0] : limits[-1]], limits - limits[0]
