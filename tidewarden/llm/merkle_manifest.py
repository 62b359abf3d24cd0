"""A Merkle manifest of a dataset: sibling-shift self-joins, level by level.

Every row is a leaf: the SHA-256 of its fields, each with its length. Leaves of one group (source)
are numbered in order; every ``arity`` consecutive nodes become one parent, until one node is
left: the group's subroot. Subroots, in order, make a tree of their own, whose last node is the
root.

A level is one table (group, index, digest). Each node finds its siblings by equality joins on the
computed index of the sibling (``index XOR 1`` for two; the slot shifted by 1, 2, ... within the
run otherwise), so the keys are unique, no group of any size meets in one task, and a level costs
a shuffle of its own nodes only. Nodes in slot zero then emit the parents. On the way down, the
siblings of a node are put before the path of its parent, once per node of each level, so only
the leaves carry whole paths. Levels are written, not kept in lineage.

``build`` gives the manifest: leaves with digest, subroot, path (siblings to the left and to the
right per level, as raw digests), and the root. ``fold`` recomputes a root from any leaf and a path;
``proof`` is the digest of all siblings of a path.

Defined cases: a null field is ``-``; a null group is a group of its own and comes first; a null
order key comes first; rows with one order key are ordered by their digest; repeated rows are leaves
of their own; a lone leaf is its group's subroot, and a lone group's subroot is the root; an empty
table has no leaves and no root (None); only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.llm.common import fold as crc_fold
from tidewarden.llm.common import read, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
BROADCAST_RUNS = 100_000
PATH = "array<struct<l:binary,r:binary>>"


def field(value: Column) -> Column:
    """``-`` or UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Raw digest of the fields of a row."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(digests: Column) -> Column:
    """Raw digest of raw digests that lie one after the other; they enter as hex text."""
    return F.unhex(F.sha2(hexed(digests), 256))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds _i, the place of a row within its group from 0 on, and _n, the size of the group.

    Rows are range-sorted, so a group of any size spreads over tasks; one count per group and
    range gives the offsets.
    """
    spread = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = written(spread.select("*", F.monotonically_increasing_id().alias("_at")), "merkle-leaves")
    part = F.shiftright("_at", 33).alias("_part")
    runs = placed.groupBy(F.col(group).alias("_of"), part).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    before = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_of", F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(Window.partitionBy("_of")).alias("_n"),
    )
    runs = written(runs, "merkle-runs")
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    found = placed.join(runs, (F.col(group) == F.col("_of")) & (F.shiftright("_at", 33) == F.col("_p")))
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_i"), "_n")


def siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (_g, _i, _n, _d, ...) with _l and _r: the siblings to the left and to the right."""
    slot = F.col("_i") % arity
    out = nodes
    for shift in range(1, arity):
        at = F.col("_i").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("_i") - slot + (slot + shift) % arity
        other = nodes.select(F.col("_g").alias("_og"), F.col("_i").alias("_oi"), F.col("_d").alias(f"_s{shift}"))
        out = out.withColumn("_k", at).join(other, (F.col("_g") == F.col("_og")) & (F.col("_k") == F.col("_oi")), "left")
        out = out.drop("_k", "_og", "_oi")
    none = F.lit(b"")
    shifted = F.array(none, *[F.coalesce(f"_s{s}", none) for s in range(1, arity)])
    own = lambda j: F.get(shifted, F.pmod(F.lit(j) - slot, F.lit(arity)).cast("int"))
    left = F.concat(*[F.when(slot > j, own(j)).otherwise(none) for j in range(arity)])
    right = F.concat(*[F.when(slot < j, own(j)).otherwise(none) for j in range(arity)])
    return out.select(*nodes.columns, left.alias("_l"), right.alias("_r"))


def parents(linked: DataFrame, arity: int) -> DataFrame:
    """The next level, from the nodes in slot zero."""
    up = F.expr(f"_n div {arity} + if(_n % {arity} > 0, 1, 0)")
    first = linked.filter(F.col("_i") % arity == 0)
    return first.select("_g", F.expr(f"_i div {arity}").alias("_i"), up.alias("_n"), _parent(F.concat("_d", "_r")).alias("_d"))


def _rounds(nodes: int, arity: int) -> int:
    out = 0
    while nodes > 1:
        nodes, out = -(-nodes // arity), out + 1
    return out


def climb(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes with siblings, lone nodes) per level; a group's lone node is its last."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    linked, lone = [], [nodes.filter("_n = 1")]
    for level in range(_rounds(most, arity)):
        linked.append(written(siblings(nodes.filter("_n > 1"), arity), f"merkle-up-{level}"))
        nodes = parents(linked[-1], arity)
        lone.append(nodes.filter("_n = 1"))
    return linked, lone


def descend(linked: list[DataFrame], lone: list[DataFrame], ends: DataFrame, arity: int) -> DataFrame:
    """The lowest nodes with _path; ``ends`` holds the path above each group's last node.

    ``ends``: _e (group), _path, and more columns that every node of the group gets.
    """
    more = [c for c in ends.columns if c not in ("_e", "_path")]
    step = F.array(F.struct(F.col("_l").alias("l"), F.col("_r").alias("r")))

    def level(k: int, above: DataFrame | None) -> DataFrame:
        kept = [c for c in lone[k].columns if c not in ("_n",)]
        out = lone[k].join(ends, F.col("_g") == F.col("_e")).select(*kept, *more, "_path")
        if above is None:
            return out
        up = above.select(F.col("_g").alias("_ug"), F.col("_i").alias("_ui"), *more, F.col("_path").alias("_up"))
        own = linked[k].withColumn("_k", F.expr(f"_i div {arity}"))
        own = own.join(up, (F.col("_g") == F.col("_ug")) & (F.col("_k") == F.col("_ui")))
        return out.unionByName(own.select(*kept, *more, F.concat(step, "_up").alias("_path")))

    found = None
    for k in range(len(linked), -1, -1):
        found = level(k, found)
        if k and found is not None:
            found = written(found, f"merkle-down-{k}")
    return found


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the kept columns, _d (digest), subroot, _path; ``root``: raw digest or None."""

    leaves: DataFrame
    root: bytes | None


def build(rows: DataFrame, digest: Column, group: Column, order: Column, keep: list, arity: int = ARITY) -> Manifest:
    """The manifest of ``rows``; ``keep`` are columns that the leaves carry along."""
    base = rows.select(
        field(group).alias("_g"), group.cast("string").alias("_name"), order.alias("_o"), digest.alias("_d"), *keep
    )
    leaves = numbered(base, "_g", [F.col("_o").asc_nulls_first(), F.col("_d").asc()]).drop("_o")
    linked, lone = climb(leaves, arity)
    # One row per group: its name (for the order of the groups) and its last node.
    names = leaves.filter("_i = 0").select(F.col("_g").alias("_ng"), F.col("_name").alias("_nn"))
    last = lone[0].select("_g", "_d")
    for level in lone[1:]:
        last = last.unionByName(level.select("_g", "_d"))
    tops = last.join(names, F.col("_g") == F.col("_ng")).select(
        F.lit("").alias("_g"), F.col("_g").alias("_sub"), F.col("_nn").alias("_name"), "_d"
    )
    tops = numbered(tops, "_g", [F.col("_name").asc_nulls_first()])
    up, ends = climb(tops.drop("_name"), arity)
    # Written: against a constant the join with it would be planned as a cross join.
    only = rows.sparkSession.range(1).select(F.lit("").alias("_e"), F.array().cast(PATH).alias("_path"))
    only = written(only, "merkle-top")
    paths = descend(up, ends, only, arity)
    root = ends[-1].select("_d").first()
    ends = paths.select(F.col("_sub").alias("_e"), F.col("_d").alias("subroot"), "_path")
    ends = written(ends, "merkle-groups")
    found = descend(linked, lone, ends, arity)
    return Manifest(found.drop("_g", "_i", "_name"), None if root is None else bytes(root[0]))


def fold(digest: Column, path: Column) -> Column:
    """Root, as hex text, from a leaf's raw digest and a path."""
    step = lambda acc, s: F.sha2(F.concat(hexed(s["l"]), acc, hexed(s["r"])), 256)
    return F.aggregate(path, hexed(digest), step)


def proof(path: Column) -> Column:
    """Hex digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: hexed(F.concat(s["l"], s["r"]))), ""), 256)


def tampered(text: Column) -> Column:
    """What the check rows suffer: their line ends are gone."""
    return F.replace(text, F.lit("\n"), F.lit(""))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(crc_fold("doc_id", 2) == 0, leaf([*fields[:-1], tampered(F.col("text"))]))
    made = build(docs, leaf(fields), F.col("source"), F.col("doc_id"), ["doc_id", changed.alias("changed")])
    root = F.lit(made.root.hex() if made.root else None).cast("string")
    folded = fold(F.coalesce("changed", "_d"), F.col("_path")).alias("folded_root")
    out = made.leaves.select(
        "doc_id", hexed(F.col("_d")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"),
        proof(F.col("_path")).alias("proof_sha256"), folded,
    )
    return out.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(name: str) -> str:
    return f"coalesce(strlen(({name})::VARCHAR)::VARCHAR || ':' || ({name})::VARCHAR, '-')"


_HEAD = " || ".join(_field_sql(c) for c in FIELDS[:-1])
_SQL = f"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, * FROM documents),
leaves AS (SELECT r, doc_id, source, sha256({_HEAD} || {_field_sql("text")}) AS leaf,
    sha256({_HEAD} || {_field_sql("replace(text, chr(10), '')")}) AS changed FROM doc),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
up(l, source, i, n, d) AS (SELECT 0, source, i, n, leaf FROM placed UNION ALL
  SELECT l + 1, source, i // 3, (max(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1
  GROUP BY l, source, i // 3),
subs AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(l, i, n, d) AS (SELECT 0, i, n, d FROM subs UNION ALL
  SELECT l + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l, i // 3),
bytes(b, k, v) AS (SELECT b, 0, b::BIGINT FROM range(256) x(b) UNION ALL
  SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bytes WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bytes WHERE k = 8),
own AS (SELECT placed.*, doc_id IS NULL OR xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 2 = 0 AS hit FROM placed, crc),
walk(r, l, source, i, n, cur, proof) AS (
  SELECT r, 0, source, i, n, CASE WHEN hit THEN changed ELSE leaf END, '' FROM own UNION ALL
  SELECT w.r, w.l + 1, w.source, w.i // 3, (w.n + 2) // 3,
    sha256(string_agg(CASE WHEN u.i = w.i THEN w.cur ELSE u.d END, '' ORDER BY u.i)),
    w.proof || coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (WHERE u.i <> w.i), '')
  FROM walk w JOIN up u ON u.source IS NOT DISTINCT FROM w.source AND u.l = w.l AND u.i // 3 = w.i // 3
  WHERE w.n > 1 GROUP BY w.r, w.l, w.source, w.i, w.n, w.cur, w.proof),
rise(r, l, i, n, cur, proof) AS (
  SELECT w.r, 0, s.i, s.n, w.cur, w.proof FROM walk w JOIN subs s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL
  SELECT w.r, w.l + 1, w.i // 3, (w.n + 2) // 3,
    sha256(string_agg(CASE WHEN u.i = w.i THEN w.cur ELSE u.d END, '' ORDER BY u.i)),
    w.proof || coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (WHERE u.i <> w.i), '')
  FROM rise w JOIN top u ON u.l = w.l AND u.i // 3 = w.i // 3 WHERE w.n > 1
  GROUP BY w.r, w.l, w.i, w.n, w.cur, w.proof)
SELECT p.doc_id, p.leaf, s.d AS subroot, t.d AS root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root,
  e.cur = t.d AS verified
FROM rise e JOIN placed p ON p.r = e.r JOIN subs s ON s.source IS NOT DISTINCT FROM p.source, (SELECT d FROM top WHERE n = 1) t
WHERE e.n = 1"""

QUERIES = {"op12_merkle_manifest": query}
ORACLES = {"op12_merkle_manifest": _SQL}
