"""Exact duplicates: two-pass Bloom filtering keeps all rows but the possibly repeated ones in place.

The first pass writes one narrow row per document (id, length, SHA-256 of the text without ASCII
white space) and counts, per bit of a blocked Bloom filter, how many rows set it; bits set twice
or more make the second filter. The second pass tests every row against it: a row with a bit that
no other row has set is surely alone and passes straight through. Only the others shuffle, as
narrow rows, to be grouped by their full digest; texts never do. Counts are combined before the
shuffle, and groups that hold more than a fixed share of the suspects are joined by broadcast
(there are at most ``HEAVY`` of them), so one text may fill a third of the table.

The filter has ``BITS`` bits per row, in blocks of ``SEGMENTS`` x ``SEGMENT`` bits; a lone row is
a suspect with a chance of about 1.4 %. It is broadcast up to ``BROADCAST_BLOCKS`` blocks (32 MB
of bits, 16 million rows); beyond that the keys (not the texts) meet it in an ordinary join.

Of equal texts stays the row with the most code points in the original, then the smallest id, a
missing id last, then the smaller hash of the original text, then the first row as stored.
Defined cases: a null text is empty, and all texts of white space alone are equal to it; rows
that are repeated with their id are a group like any other, of which one stays; an empty table
gives an empty result; columns other than id and text are not read by ``judge`` and come back
unchanged from ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import GAP, free_name, read, text_of, written

BITS = 16
SEGMENTS, SEGMENT = 2, 256
BLOCK = SEGMENTS * SEGMENT
BROADCAST_BLOCKS = 1 << 19
HEAVY = 10_000


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text, as lowercase hex."""
    return F.sha2(F.regexp_replace(text_of(text), GAP, ""), 256)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """One row per document: id, chars, sha, tie, row (its number as stored) and the columns ``more``."""
    value = text_of(text)
    return docs.select(
        *more,
        F.col(f"`{key}`").alias("id"),
        F.length(value).alias("chars"),
        digest(text).alias("sha"),
        F.xxhash64(value).alias("tie"),
    ).withColumn("row", F.monotonically_increasing_id())


def blocks_for(rows: int) -> int:
    """Blocks of a filter for so many rows: a power of two."""
    return 1 << max(0, -(-rows * BITS // BLOCK) - 1).bit_length()


def _block(blocks: int) -> Column:
    return F.xxhash64("sha").bitwiseAND(F.lit(blocks - 1))


def _offsets() -> list[Column]:
    """The bits of a row in its block: one in each segment, so they never fall together."""
    h = F.xxhash64("sha", F.lit(1))
    return [F.pmod(F.shiftright(h, 16 * i), F.lit(SEGMENT)).cast("int") for i in range(SEGMENTS)]


def repeated_bits(rows: DataFrame, blocks: int) -> DataFrame:
    """The second filter: block, words; bits that two or more rows set."""
    base = _block(blocks) * BLOCK
    places = F.array(*[base + i * SEGMENT + at for i, at in enumerate(_offsets())])
    twice = rows.select(F.explode(places).alias("place")).groupBy("place").count().filter("count > 1")
    word, bit = F.expr(f"cast(place % {BLOCK} div 64 as int)"), F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = [F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")) for i in range(BLOCK // 64)]
    return twice.groupBy(F.expr(f"place div {BLOCK}").alias("block")).agg(F.array(*words).alias("words"))


def possibly_repeated(rows: DataFrame, twice: DataFrame, blocks: int, broadcast: bool) -> DataFrame:
    """``rows`` with ``suspect``: whether all bits of the row's hash are set by another row too."""
    row = rows.select("*", _block(blocks).alias("block"))
    found = row.join(F.broadcast(twice) if broadcast else twice, "block", "left")
    bits = [
        F.getbit(F.get("words", (at / 64).cast("int") + i * (SEGMENT // 64)), at % 64) == 1
        for i, at in enumerate(_offsets())
    ]
    every = bits[0]
    for b in bits[1:]:
        every = every & b
    return found.select(*rows.columns, F.coalesce(every, F.lit(False)).alias("suspect"))


def _tested(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``rows`` (with ``sha``) tested against the filter of the written narrow table."""
    blocks = blocks_for(narrow.count())
    twice = written(repeated_bits(narrow, blocks), "dedup-filter")
    return possibly_repeated(rows, twice, blocks, blocks <= BROADCAST_BLOCKS)


def _order() -> Column:
    return F.struct((-F.col("chars")).alias("a"), F.col("id").isNull().alias("b"), "id", "tie", "row")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, keep (id of the row that stays), group_size, kept, sha for every document."""
    narrow = written(digests(docs, key, text), "dedup-digests")
    tested = _tested(narrow, narrow)
    alone = tested.filter(~F.col("suspect")).select(
        "id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    suspects = written(tested.filter("suspect").drop("suspect"), "dedup-suspects")
    groups = suspects.groupBy("sha").agg(F.count("*").alias("group_size"), F.min(_order()).alias("best"))
    groups = groups.select("sha", "group_size", F.col("best.id").alias("keep"), F.col("best.row").alias("best"))
    groups = written(groups, "dedup-groups")
    # Fewer than HEAVY groups can hold more than this many rows each.
    heavy = F.col("group_size") > max(1000, suspects.count() // HEAVY)
    shown = ["id", "keep", "group_size", (F.col("row") == F.col("best")).alias("kept"), "sha"]
    near = suspects.join(F.broadcast(groups.filter(heavy)), "sha", "left")
    large = near.filter("best is not null").select(*shown)
    small = near.filter("best is null").select(*suspects.columns)
    small = small.join(groups.filter(~heavy), "sha").select(*shown)
    return alone.unionByName(large).unionByName(small)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, unchanged; rows that are surely alone are not shuffled."""
    whole = free_name(docs, "_row")
    narrow = written(digests(docs, key, text), "dedup-digests")
    value = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole)
    rows = digests(docs.select("*", value), key, text, whole)
    tested = _tested(rows, narrow)
    alone = tested.filter(~F.col("suspect")).select(f"{whole}.*")
    best = tested.filter("suspect").groupBy("sha").agg(F.min_by(whole, _order()).alias(whole))
    return alone.unionByName(best.select(f"{whole}.*"))


def query(spark, sf_dir: str) -> DataFrame:
    found = judge(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.col("sha").alias("text_sha256")
    )


_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)"""

QUERIES = {"op11_exact_dedup": query}
ORACLES = {"op11_exact_dedup": _SQL}
