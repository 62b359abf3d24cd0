"""Retention and compaction of tables partitioned by day."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewarden.schema import COMPACT_AFTER_DAYS, STREAM_RETENTION, TABLE_RETENTION_DAYS
from tidewarden.sources import files

MARKER = "_compacted"
SWAP_THREADS = 16


def days(spark: SparkSession, path: str, column: str = "event_date") -> list[dt.date]:
    prefix = f"{column}="
    return [
        dt.date.fromisoformat(n.removeprefix(prefix))
        for n in files.children(spark, path)
        if n.startswith(prefix) and not n.endswith("__HIVE_DEFAULT_PARTITION__")
    ]


def drop_expired(
    spark: SparkSession,
    path: str,
    as_of: dt.datetime,
    keep: dt.timedelta = dt.timedelta(days=TABLE_RETENTION_DAYS),
    column: str = "event_date",
) -> list[dt.date]:
    """Drop every day that lies wholly before ``as_of - keep``. No data is read."""
    edge = as_of - keep
    dropped = []
    for day in days(spark, path, column):
        end = dt.datetime.combine(day, dt.time(), dt.UTC) + dt.timedelta(days=1)
        if end <= edge:
            files.delete(spark, f"{path}/{column}={day}")
            dropped.append(day)
    return dropped


def stream_retention(stream: str) -> dt.timedelta:
    amount, unit = STREAM_RETENTION[stream].split()
    return dt.timedelta(**{unit: int(amount)})


def compact(
    spark: SparkSession,
    path: str,
    as_of: dt.datetime,
    older_than: dt.timedelta = dt.timedelta(days=COMPACT_AFTER_DAYS),
    target_bytes: int = 256 << 20,
) -> list[dt.date]:
    """Rewrite old days ordered by source, flag and time (newest first).

    Rows are range-partitioned on the full sort order, so a source that owns most
    of a day is spread over many files instead of landing in one task, and row
    group statistics then prune by source, flag and time. All days that are due
    are rewritten to the side in one job, and the list of files read is stored with
    them. Then, per day, exactly those files are moved out and the new ones in, so a
    file written meanwhile stays. A day that has had no new files since its last
    rewrite is skipped. A run that broke off is finished, or undone, by the next one.
    """
    recover(spark, path)
    due: dict[dt.date, list[str]] = {}
    for day in days(spark, path):
        end = dt.datetime.combine(day, dt.time(), dt.UTC) + dt.timedelta(days=1)
        folder = f"{path}/event_date={day}"
        newest = files.newest(spark, folder)
        if end <= as_of - older_than and newest is not None and newest[0] != MARKER:
            due[day] = [n for n in files.children(spark, folder) if not n.startswith(("_", "."))]
    if not due:
        return []
    sources = [f"{path}/event_date={day}/{n}" for day, names in due.items() for n in names]
    size = sum(files.size_of(spark, f"{path}/event_date={day}") for day in due)
    order = ["event_date", "source_id", "is_anomaly", F.desc("event_time")]
    side = f"{path}/_compacting/{uuid.uuid4().hex}"
    (
        spark.read.option("basePath", path)
        .parquet(*sources)
        .repartitionByRange(max(len(due), math.ceil(size / target_bytes)), *order)
        .sortWithinPartitions(*order)
        .write.partitionBy("event_date")
        .parquet(f"{side}/new")
    )
    read = [(f"event_date={day}", name) for day, names in due.items() for name in names]
    spark.createDataFrame(read, "folder string, name string").coalesce(1).write.parquet(f"{side}/read")
    swap(spark, path, side)
    return list(due)


def swap(spark: SparkSession, path: str, side: str) -> None:
    """Put the rewritten files of ``side`` in place of those they were made from; can be repeated."""
    read: dict[str, list[str]] = {}
    for r in spark.read.parquet(f"{side}/read").collect():  # one row per file that was rewritten
        read.setdefault(r.folder, []).append(r.name)

    def one_day(entry: tuple[str, list[str]]) -> None:
        folder, names = entry
        present = set(files.children(spark, f"{path}/{folder}"))
        for name in names:
            if name in present:
                files.move(spark, f"{path}/{folder}/{name}", f"{side}/old/{folder}/{name}")
        for name in files.children(spark, f"{side}/new/{folder}"):
            files.move(spark, f"{side}/new/{folder}/{name}", f"{path}/{folder}/{name}")
        files.touch(spark, f"{path}/{folder}/{MARKER}")

    # Renames wait for the file system: days go side by side, so each is absent for a moment only.
    with ThreadPoolExecutor(SWAP_THREADS) as pool:
        list(pool.map(one_day, sorted(read.items())))
    files.delete(spark, side)


def recover(spark: SparkSession, path: str) -> int:
    """Finish compactions that broke off while files were swapped, drop those that did not get there."""
    sides = [f"{path}/_compacting/{name}" for name in files.children(spark, f"{path}/_compacting")]
    for side in sides:
        if files.exists(spark, f"{side}/read/_SUCCESS"):
            swap(spark, path, side)
        else:
            files.delete(spark, side)
    return len(sides)
