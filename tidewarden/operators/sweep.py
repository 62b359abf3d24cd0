"""Sliding windows over a per-key timeline that no single task has to hold.

A frame such as "the last 60 seconds of this source" would put a whole source in
one task and re-add every frame from scratch. Here each row is turned into
markers instead: one where it enters the window and one where it leaves. A
running sum over the markers is the window total, in one pass. The timeline of
a key is cut into chunks, and a row whose window reaches into the next chunk is
also entered there, so (key, chunk) can be worked on alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.session import cut_lineage


def markers(
    df: DataFrame,
    key: str,
    ms: str,
    leaves_at: Column,
    counts: Column,
    chunk_ms: int,
    value_columns: list[str],
) -> DataFrame:
    """Marker rows of ``df``; needs ``leaves_at - ms <= chunk_ms``.

    Result: ``key``, ``chunk``, ``at``, ``phase`` (0 leave, 1 enter), ``sign``
    (+1, -1, or 0 for a row that only reads), the value columns, and ``row`` (the
    input row on its own entry marker, null on all others). Markers that neither
    carry a row nor count are not created.
    """
    if any(c in df.columns for c in ("chunk", "at", "phase", "sign", "row")):
        raise ValueError("input uses a reserved column name")
    chunk_of = lambda c: F.floor(c / F.lit(chunk_ms))
    t = F.col(ms)
    row = F.struct(*[F.col(c) for c in df.columns])
    no_row = F.lit(None)

    def marker(chunk: Column, at: Column, phase: int, sign: Column, payload: Column) -> Column:
        return F.struct(
            chunk.alias("chunk"),
            at.alias("at"),
            F.lit(phase).alias("phase"),
            sign.cast("int").alias("sign"),
            payload.alias("row"),
        )

    crosses = counts & (chunk_of(leaves_at) != chunk_of(t))
    entry = marker(chunk_of(t), t, 1, F.when(counts, 1).otherwise(0), row)
    again = marker(chunk_of(leaves_at), t, 1, F.lit(1), no_row)
    leave = marker(chunk_of(leaves_at), leaves_at, 0, F.lit(-1), no_row)
    # Without a branch per case the array would carry null markers to filter out.
    all_markers = (
        F.when(crosses, F.array(entry, again, leave))
        .when(counts, F.array(entry, leave))
        .otherwise(F.array(entry))
    )
    return df.select(key, *[c for c in value_columns if c != key],
                     F.explode(all_markers).alias("m")).select(
        key, *[c for c in value_columns if c != key], "m.*"
    )


# Marker rows of one chunk that one task works through; beyond it the chunk is split by rows.
STORM = 1_000_000


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def storms(m: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of all other chunks, rows of the chunks with more than ``most`` rows or None).

    At most one chunk in ``most`` rows is large, so the list of them is small.
    """
    heavy = m.groupBy(*keys).count().filter(F.col("count") > most)
    heavy = cut_lineage(heavy.select(*[F.col(k).alias(f"_heavy_{k}") for k in keys]))
    if heavy.isEmpty():
        return m, None
    heavy = F.broadcast(heavy)
    inside = [_same(k, f"_heavy_{k}") for k in keys]
    return m.join(heavy, inside, "left_anti"), m.join(heavy, inside, "left_semi")


def running(
    m: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    newest: dict[str, Column] | None = None,
    most: int = STORM,
) -> DataFrame:
    """Running sums, and last values that are not null, over the rows of a chunk up to each row.

    Chunks bound a timeline by time, not by rows. One with more than ``most`` rows is range-sorted
    over tasks instead, whatever its times; sums and last values of the parts before a part are
    carried into it, so all events of a source in one minute, or one millisecond, still spread.
    """
    sums, newest = sums or {}, newest or {}
    names = [*sums, *newest]

    def within(df: DataFrame, parts: list[str], by: list[str]) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = [F.sum(v).over(w).alias(n) for n, v in sums.items()]
        added += [F.last(v, ignorenulls=True).over(w).alias(n) for n, v in newest.items()]
        return df.select("*", *added)

    rest, hot = storms(m, keys, most)
    if hot is None:
        return within(rest, keys, order)
    spread = hot.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    spread = cut_lineage(spread.withColumn("_row", F.monotonically_increasing_id()))
    spread = spread.withColumn("_part", F.shiftright("_row", 33))
    ends = spread.groupBy(*keys, "_part").agg(
        *[F.sum(v).alias(n) for n, v in sums.items()],
        *[F.max_by(v, F.when(v.isNotNull(), F.col("_row"))).alias(n) for n, v in newest.items()],
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_of_{k}") for k in [*keys, "_part"]],
        *[F.sum(n).over(before).alias(f"_to_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_to_{n}") for n in newest],
    )
    # One row per chunk and range partition.
    found = within(spread, [*keys, "_part"], ["_row"])
    found = found.join(F.broadcast(carried), [_same(k, f"_of_{k}") for k in [*keys, "_part"]])
    total = [(F.coalesce(F.col(f"_to_{n}"), F.lit(0)) + F.col(n)).alias(n) for n in sums]
    total += [F.coalesce(n, f"_to_{n}").alias(n) for n in newest]
    found = found.select(*m.columns, *total)
    return within(rest, keys, order).select(*m.columns, *names).unionByName(found)
