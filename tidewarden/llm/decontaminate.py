"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case runs of letters and digits. A mask such as ``11..11`` slides over the
tokens and hashes those under a 1, so the positions under a dot may differ. Hashes of the
documents are joined with those of the benchmark items; around every hit the two texts are laid
side by side and the tokens that agree are counted. A document is contaminated by an item when
at least ``SHARE`` of the tokens around a hit agree: up to ``REACH`` tokens more than the mask
on either side, as far as the item goes.

Items of at least ``SPAN`` tokens are found by ``MASKS``, shorter ones down to ``SHORT`` tokens
by an unspaced mask and compared whole. These masks alone miss some places of changed tokens, so
the lighter ones of ``COVER`` look for every place that ``SHARE`` allows, in all windows that hold
the hit. Items of fewer tokens cannot be told from chance inside a text; with ``tiny`` (the query
and ``remove`` use it) a document is contaminated by one when it consists of the same tokens.

The documents are read once and never shuffled while the table of item hashes is small: its size
is counted and it is broadcast up to ``BROADCAST_BYTES``. Beyond that blocks of tokens are written
once, only (block, hash) pairs are shuffled to find the blocks with a hit, and the tokens of those
alone are fetched. Defined cases: null or empty texts and items match nothing; repeated item ids are treated as one item
with several texts, a null id is an id of its own; several hits give one row per document and
item; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import free_name, read, text_of, written

# Fixed masks: each leaves out other positions.
MASKS = ("1111....1111", "11..1111..11", "1.11.11.1111")
SPAN = 12
SHORT = 5
REACH = 2
SHARE = 0.8
# For items of so many tokens, masks that leave no place to hide. A compared window of 12 to 14
# tokens has at most two changed ones, so two of any four runs of three are whole; one of 15 or
# 16 has at most three, so two of five runs are. Likewise runs of two below 12 tokens: one change
# in 6 to 9, two in 10 and 11. Five tokens have one change.
COVER = (
    (5, 5, ("1111", "1.111", "11.11", "111.1")),
    (6, 11, ("1111", "11..11", "11....11")),
    (12, None, ("111111", "111...111", "111......111", "111.........111")),
)
BROADCAST_BYTES = 64 << 20
BLOCK = 256


def tokens_of(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.array_remove(F.split(clean, " "), "")


def masks(masks_used=MASKS, short: int = SHORT) -> list[tuple[int, tuple[int, ...], int]]:
    """(number, positions used, length) of every mask; number 0 is the unspaced one."""
    spaced = [(k, tuple(i for i, c in enumerate(m) if c == "1"), len(m)) for k, m in enumerate(masks_used, 1)]
    return [(0, tuple(range(short)), short), *spaced]


def groups() -> list[tuple[int, int | None, list[tuple[int, tuple[int, ...], int]], bool]]:
    """(least, most tokens of an item, its masks, whether a hit is compared in its own window only)."""
    names = list(dict.fromkeys(m for _, _, group in COVER for m in group))
    first = len(masks())
    cover = dict(zip(names, masks(names)[1:]))
    numbered = {m: (first + k - 1, places, span) for m, (k, places, span) in cover.items()}
    fixed = [(SHORT, SPAN - 1, masks()[:1], True), (SPAN, None, masks()[1:], True)]
    return fixed + [(a, b, [numbered[m] for m in group], False) for a, b, group in COVER]


def _blocks(rows: DataFrame) -> DataFrame:
    """Long token lists cut into blocks of ``BLOCK`` positions with the neighbours a hit can need.

    Rows of bounded size keep the work linear in the length of a text.
    """
    start = F.sequence(F.lit(0), F.greatest(F.size("_tokens") - 1, F.lit(0)), F.lit(BLOCK))
    margin = SPAN + 2 * REACH
    cut = F.transform(
        start,
        lambda s: F.struct(
            F.greatest(s - margin, F.lit(0)).alias("from"),
            s.alias("first"),
            F.slice("_tokens", F.greatest(s - margin, F.lit(0)) + 1, BLOCK + 2 * margin).alias("tokens"),
        ),
    )
    keep = [c for c in rows.columns if c != "_tokens"]
    rows = rows.select(*keep, F.explode_outer(cut).alias("_b"))
    return rows.select(
        *keep, F.col("_b.from").alias("_from"), F.col("_b.first").alias("_lo"), F.col("_b.tokens").alias("_tokens")
    )


def _positions(rows: DataFrame, used, without: tuple[str, ...] = ()) -> DataFrame:
    """One row per token position and mask that fits there, with the hash of the tokens under it."""
    keep = [c for c in rows.columns if c not in without]
    rows = rows.select("*", F.transform("_tokens", lambda w: F.xxhash64(w)).alias("_h"))
    # The outer form keeps the optimizer from cleaning every text twice for an emptiness test.
    rows = rows.select("*", F.posexplode_outer("_h").alias("_at", "_first"))
    own = F.col("_from") + F.col("_at")
    rows = rows.filter((own >= F.col("_lo")) & (own < F.col("_lo") + BLOCK))
    n, at = F.size("_h"), F.col("_at")
    seeds = [
        F.when(at + span <= n, F.xxhash64(F.lit(k), *[F.get("_h", at + d) for d in places]))
        for k, places, span in used
    ]
    rows = rows.select(*keep, "_at", F.posexplode(F.array(*seeds)).alias("_mask", "_seed"))
    spans = F.array(*[F.lit(span) for _, _, span in used])
    return rows.filter(F.col("_seed").isNotNull()).select(
        *keep, "_at", F.get(spans, F.col("_mask")).alias("_span"), "_seed"
    )


def item_seeds(items: DataFrame, id_column: str = "item_id") -> DataFrame:
    """Hashes of the benchmark: item, its tokens, position and span of the mask."""
    t = items.select(F.col(id_column).alias("_item"), tokens_of(text_of("text")).alias("_whole"))
    t = t.select("_item", "_whole", F.col("_whole").alias("_tokens"))
    parts = []
    for number, (least, most, used, fixed) in enumerate(groups()):
        n = F.size("_whole")
        found = _positions(_blocks(t.filter((n >= least) if most is None else n.between(least, most))), used)
        at, zero = F.col("_from") + F.col("_at"), F.lit(0)
        # Starts of the spans whose windows a hit is compared in.
        if most is not None:
            low = high = zero
        elif fixed:
            low = high = at
        else:
            low, high = F.greatest(zero, at + F.col("_span") - SPAN - REACH), F.least(n - SPAN, at + REACH)
        begin = lambda p: zero if most is not None else F.greatest(zero, p - REACH)  # noqa: B023, E731
        end = lambda p: n if most is not None else F.least(n, p + SPAN + REACH)  # noqa: B023, E731
        first = begin(low)
        found = found.select(
            F.col("_item").alias("item_id"),
            # The tokens a hit is compared with, where the mask starts and the windows among them.
            F.slice("_whole", first + 1, end(high) - first).alias("_item_tokens"),
            (at - first).alias("_before"),
            F.transform(
                F.sequence(low, high),
                lambda p: F.struct((begin(p) - first).alias("lo"), (end(p) - begin(p)).alias("n")),
            ).alias("_windows"),
            F.col("_seed").alias("_item_seed"),
            F.lit(number).alias("_group"),
        )
        parts.append(found)
    return reduce(DataFrame.unionAll, parts)


def _best_share() -> Column:
    """The best share of agreeing tokens in a window of a hit, null when none reaches ``SHARE``."""
    at = F.col("_at") - F.col("_before")
    same = F.transform("_item_tokens", lambda w, j: F.get("_tokens", at + j).eqNullSafe(w))
    # transform over a one-element array binds the comparisons to a name.
    shares = F.transform(
        F.array(same),
        lambda s: F.array_max(
            F.transform(
                "_windows",
                lambda w: F.transform(
                    F.array(F.size(F.filter(F.slice(s, w["lo"] + 1, w["n"]), lambda x: x))),
                    lambda k: F.when(k >= w["n"] * SHARE, k / w["n"]),
                )[0],
            )
        ),
    )
    return shares[0]


def _block_hits(t: DataFrame, seeds: DataFrame, used) -> DataFrame:
    """Hits without a broadcast: pairs of block and hash travel, then the tokens of blocks with a hit."""
    blocks = written(_blocks(t).withColumn("_block", F.monotonically_increasing_id()), "leak-blocks")
    pairs = _positions(blocks, used, tuple(c for c in blocks.columns if c != "_block")).select("_block", "_seed")
    keys = seeds.select(F.col("_item_seed").alias("_seed")).distinct()
    near = written(pairs.join(keys, "_seed", "left_semi").select("_block").distinct(), "leak-near")
    near = written(blocks.join(near, "_block", "left_semi"), "leak-tokens")
    places = _positions(near, used, tuple(c for c in near.columns if c != "_block")).select("_block", "_at", "_seed")
    hits = places.join(seeds, F.col("_seed") == F.col("_item_seed"))
    return hits.join(near, "_block")


def _tiny(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """Documents that consist of an item of fewer than ``SHORT`` tokens."""
    few = F.size("_tokens").between(1, SHORT - 1)
    d = docs.select(F.col(doc_id).alias("doc_id"), tokens_of(text_of("text")).alias("_tokens")).filter(few)
    i = items.select(F.col(item_id).alias("item_id"), tokens_of(text_of("text")).alias("_tokens")).filter(few).distinct()
    same = d.join(i, "_tokens").groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"))
    return same.select("doc_id", "item_id", F.lit(1.0).alias("overlap"), "hits", F.lit(0).cast("long").alias("first_pos"))


def overlaps(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", tiny: bool = False
) -> DataFrame:
    """doc_id, item_id, overlap (best share of agreeing tokens), hits, first_pos of contaminated pairs.

    With ``tiny`` items of fewer than ``SHORT`` tokens are compared too, with whole documents.
    """
    seeds = written(item_seeds(items, item_id), "item-seeds")
    facts = seeds.agg(
        F.collect_set("_group").alias("groups"),
        F.coalesce(F.sum(F.lit(80) + F.size("_item_tokens") * 24 + F.size("_windows") * 32), F.lit(0)).alias("bytes"),
    ).first()
    used = {m[0]: m for k, (_, _, group, _) in enumerate(groups()) if k in facts.groups for m in group}
    used = list(used.values()) or masks()
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens_of(text_of("text")).alias("_tokens"))
    if facts.bytes <= BROADCAST_BYTES:
        hits = _positions(_blocks(t), used).join(F.broadcast(seeds), F.col("_seed") == F.col("_item_seed"))
    else:
        hits = _block_hits(t, seeds, used)
    hits = hits.select(
        "doc_id",
        "item_id",
        (F.col("_from") + F.col("_at")).alias("_pos"),
        _best_share().alias("_share"),
    )
    # The share is tested inside the aggregation: as a filter it would move into the join and
    # make its generated code too long to be compiled.
    good = F.col("_share").isNotNull()
    best = hits.groupBy("doc_id", "item_id").agg(
        F.max("_share").alias("overlap"),
        F.sum(good.cast("long")).alias("hits"),
        F.min(F.when(good, F.col("_pos"))).cast("long").alias("first_pos"),
    )
    best = best.filter("hits > 0")
    return best.unionByName(_tiny(docs, items, doc_id, item_id)) if tiny else best


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in no contaminated pair, unchanged.

    Rows that share an id with a contaminated row go with it.
    """
    name = free_name(docs, "_leaked")
    leaked = written(overlaps(docs, items, tiny=True).select(F.col("doc_id").alias(name)).distinct(), "leaked")
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), tiny=True)


def _sql() -> str:
    clean = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"

    def seeds(source: str, used, where: str = "true", more: str = "") -> str:
        return " UNION ALL ".join(
            f"SELECT *{more}, {span} AS span, '{k}' || " + " || ".join(f"' ' || t[p + {d + 1}]" for d in places)
            + f" AS seed FROM {source} WHERE p + {span} <= len(t) AND {where}"
            for k, places, span in used
        )

    every = list({m[0]: m for _, _, group, _ in groups() for m in group}.values())
    items = []
    for least, most, group, own in groups():
        where = f"len(t) >= {least}" if most is None else f"len(t) BETWEEN {least} AND {most}"
        kind = "whole" if most is not None else "own" if own else "all"
        items.append(seeds("bp", group, where, f", '{kind}' AS kind"))
    low = f"CASE kind WHEN 'whole' THEN 0 WHEN 'own' THEN i.p ELSE greatest(0, i.p + i.span - {SPAN} - {REACH}) END"
    high = f"CASE kind WHEN 'whole' THEN 0 WHEN 'own' THEN i.p ELSE least(len(i.t) - {SPAN}, i.p + {REACH}) END"
    return f"""
    WITH d AS (SELECT doc_id, {clean} AS t FROM documents),
    b AS (SELECT item_id, {clean} AS t FROM benchmark),
    dp AS (SELECT *, unnest(range(len(t))) AS p FROM d),
    bp AS (SELECT *, unnest(range(len(t))) AS p FROM b),
    i AS ({' UNION ALL '.join(items)}),
    ds AS ({seeds('dp', every)}),
    j AS (SELECT row_number() OVER () AS r, doc_id, item_id, ds.p AS p, ds.t AS a, i.t AS b, ds.p - i.p AS shift, kind,
        {low} AS low, {high} AS high FROM ds JOIN i USING (seed)),
    h AS (SELECT *, unnest(range(low, high + 1)) AS w FROM j),
    e AS (SELECT *, CASE WHEN kind = 'whole' THEN 0 ELSE greatest(0, w - {REACH}) END AS lo,
        CASE WHEN kind = 'whole' THEN len(b) ELSE least(len(b), w + {SPAN + REACH}) END AS hi FROM h),
    m AS (SELECT r, doc_id, item_id, p, hi - lo AS n, len(list_filter(range(lo, hi),
        lambda j: j + shift >= 0 AND a[j + shift + 1] IS NOT DISTINCT FROM b[j + 1])) AS same FROM e),
    g AS (SELECT doc_id, item_id, p, r, max(same::DOUBLE / n) AS share FROM m WHERE same >= n * {SHARE}::DOUBLE
        GROUP BY doc_id, item_id, p, r),
    tiny AS (SELECT d.doc_id, b.item_id, count(*)::BIGINT AS hits FROM d
        JOIN (SELECT DISTINCT item_id, t FROM b WHERE len(t) BETWEEN 1 AND {SHORT - 1}) b ON d.t = b.t GROUP BY 1, 2)
    SELECT doc_id, item_id, max(share) AS overlap, count(*)::BIGINT AS hits, min(p)::BIGINT AS first_pos
    FROM g GROUP BY doc_id, item_id
    UNION ALL SELECT doc_id, item_id, 1.0::DOUBLE, hits, 0::BIGINT FROM tiny"""


QUERIES = {"op9_decontaminate": query}
ORACLES = {"op9_decontaminate": _sql()}
