"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget: the total of all sizes shared by weight, no budget above
``CAP`` times its source's size, the excess shared anew by weight among the others. A source's
budget holds ``epochs`` complete passes; the rest is filled by weighted sampling without
replacement: each document gets the exponential key ``-ln(u) / quality``, documents are sorted
by key within their source, and their sizes are summed until the rest of the budget is met (a
document on the border is taken when at least half of it fits).

A source may hold any share of the rows, and its qualities may be anything: narrow rows (no text)
are range-sorted by source and key at sampled borders, with a random number behind equal keys and
ids, so ranges are about equal and no task sees a source. One sum per source and range gives what
lies before a range; every range is then summed on its own.

``u`` comes from the MD5 of seed and id, so reruns agree. Defined cases: a null source is a
source of its own and comes last; a null or empty text has size 0 and is taken for 0 words; a
null id counts as empty text; rows with the same id have the same key and are ordered by their
text's hash; an empty table gives an empty result. Only id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.llm.common import GAP, free_name, read, text_of, written

# Weights in the order of the sources' names, repeating; budget limit.
WEIGHTS = (5, 2, 1)
CAP = 3
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def _unit(id_column: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on seed and id only: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def quality(chars: Column, symbols: Column) -> Column:
    """Weight of a document: its share of characters that are no symbols, 0.05 at least."""
    return F.greatest(F.lit(0.05), F.when(chars > 0, 1 - symbols / chars).otherwise(1.0))


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, sampling key and tie breaker of every row; one pass over the text."""
    text = text_of("text")
    d = docs.select("doc_id", "source", text.alias("_text"))
    d = d.select(
        "doc_id",
        "source",
        F.size(F.array_remove(F.split("_text", GAP), "")).cast("long").alias("size"),
        F.length(F.regexp_replace("_text", GAP, "")).alias("_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).alias("_symbols"),
        F.xxhash64("_text").alias("tie"),
    )
    weight = quality(F.col("_chars"), F.col("_symbols"))
    return d.select("doc_id", "source", "size", (-F.log(_unit(F.col("doc_id"), seed)) / weight).alias("key"), "tie")


def budgets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size); one row per source.

    The shares settle where some sources sit at their limit and the others have one common
    ratio of budget to weight. In order of limit per weight, a source is at its limit exactly
    if the ratio reached without it and all before it is above its own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.select("source", "source_size", weight.alias("_w"))
    limit = F.col("source_size") * cap
    order = [(limit / F.col("_w")).asc(), F.col("source").asc_nulls_last()]
    up = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        F.coalesce(F.sum(limit).over(up), F.lit(0)).alias("_before"),
        F.sum("_w").over(down).alias("_rest"),
        F.sum("source_size").over(everything).alias("_all"),
    )
    capped = (F.col("_all") - F.col("_before")) * F.col("_w") > limit * F.col("_rest")
    s = s.select("*", capped.alias("_capped"))
    shared = F.col("_all") - F.sum(F.when(F.col("_capped"), limit).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("_w"))).over(everything)
    target = F.when(F.col("_capped"), limit.cast("double")).otherwise(shared * F.col("_w") / open_weight)
    return s.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: size, its source's budget, epochs and whether the rest takes it."""
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("tie")]
    # Written first: the sampling of borders would read all texts a second time.
    keys = written(keyed(docs, seed), "mix-sizes").withColumn("_any", F.rand(1))
    spread = keys.repartitionByRange(*order, F.col("_any")).sortWithinPartitions(*order, F.col("_any")).drop("_any")
    rows = written(spread.withColumn("_at", F.monotonically_increasing_id()), "mix-keys")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    sums = written(rows.groupBy("source", "_part").agg(F.sum("size").alias("_size")), "mix-sums")
    sizes = sums.groupBy("source").agg(F.sum("_size").alias("source_size"))
    target = budgets(sizes, weights, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    target = target.select("*", full.alias("epochs"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("_s"),
        F.col("_part").alias("_b"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    ranges = target.join(sums, F.col("source").eqNullSafe(F.col("_s"))).select(
        "_s", "_b", "source_size", "target", "epochs", "_offset"
    )
    ranges = written(ranges, "mix-ranges")
    if ranges.count() <= BROADCAST_SOURCES:  # one row per source and range
        ranges = F.broadcast(ranges)
    d = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_b")))
    within = Window.partitionBy("_s", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", (F.col("_offset") + F.sum("size").over(within) - F.col("size")).alias("_sum"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    part = (F.col("size") > 0) & (F.col("_sum") * 2 + F.col("size") <= rest * 2)
    return d.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "key", "tie", part.alias("in_part")
    )


def take(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Selected documents of a source are those up to a border key, so only one border per source
    travels to the texts, which are not shuffled up to ``BROADCAST_SOURCES`` sources. Documents of size 0 go: they give no words.
    """
    key = F.struct("key", "doc_id", "tie")
    border = plan(docs, weights, cap, seed).groupBy("source").agg(
        F.max("epochs").alias("_epochs"), F.max(F.when(F.col("in_part"), key)).alias("_border")
    )
    border = written(border.withColumnRenamed("source", "_source"), "mix-borders")
    if border.count() <= BROADCAST_SOURCES:
        border = F.broadcast(border)  # beyond that the texts are shuffled by source
    row = free_name(docs, "_row")
    d = docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    words = F.length(F.regexp_replace(text_of("text"), GAP, "")) > 0
    text = F.xxhash64(text_of("text"))
    symbols = F.length(F.regexp_replace(text_of("text"), r"[^#*$%&|<>]+", ""))
    chars = F.length(F.regexp_replace(text_of("text"), GAP, ""))
    own = (-F.log(_unit(F.col("doc_id"), seed)) / quality(chars, symbols)).alias("key")
    d = d.filter(words).select(row, F.col("source").alias("_of"), F.struct(own, "doc_id", text.alias("tie")).alias("_key"))
    d = d.join(border, F.col("_of").eqNullSafe(F.col("_source")))
    times = F.col("_epochs") + F.when(F.col("_key") <= F.col("_border"), 1).otherwise(0)
    d = d.filter(times > 0).select(row, F.explode(F.sequence(F.lit(1), times)).alias("_copy"))
    return d.select(f"{row}.*")


def query(spark, sf_dir: str) -> DataFrame:
    taken = F.col("size") * (F.col("epochs") + F.col("in_part").cast("long"))
    return plan(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "epochs"
    )


_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS symbols,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(2**52)}::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / greatest(0.05::DOUBLE, CASE WHEN chars > 0 THEN 1 - symbols::DOUBLE / chars ELSE 1 END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER () AS total,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM k GROUP BY source),
o AS (SELECT *, coalesce(sum({CAP} * source_size) OVER (ORDER BY {CAP} * source_size / w::DOUBLE, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY {CAP} * source_size / w::DOUBLE, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
c AS (SELECT *, (total - before) * w > {CAP} * source_size * rest AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN ({CAP} * source_size)::DOUBLE ELSE
    ((total - sum(CASE WHEN capped THEN {CAP} * source_size ELSE 0 END) OVER ()) * w)::DOUBLE
    / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target FROM c),
e AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS epochs FROM t),
r AS (SELECT k.*, source_size, target, epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id) - size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, epochs, (size * (epochs + CASE WHEN size > 0 AND
    before * 2 + size <= (target - epochs * source_size) * 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

QUERIES = {"op8_mixing": query}
ORACLES = {"op8_mixing": _SQL}
