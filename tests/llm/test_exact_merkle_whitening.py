"""Exact duplicates, Merkle manifest, whitening: brute force, and rows at the edges."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import exact_dedup, merkle_manifest, whitening

SF = "/root/testdata/sf0.001"
BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


# ---- exact duplicates ----------------------------------------------------------------------


def judged(rows):
    """(id, keep, size, kept, sha) by a plain loop; rows of (id, text)."""
    groups = defaultdict(list)
    for i, (key, text) in enumerate(rows):
        plain = (text or "").translate(BLANK)
        groups[plain].append((-len(text or ""), key is None, key or 0, i, key))
    out = []
    for plain, members in groups.items():
        best = min(members[:], key=lambda m: m[:3])
        sha = hashlib.sha256(plain.encode()).hexdigest()
        out += [(m[4], best[4], len(members), sha) for m in members]
    return sorted(out, key=str)


CASES = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n\t"), (7, "A b"), (8, "a b"), (9, "a\x0bb\r"),
         (10, "é" * 5), (11, "x " * 60_000), (12, "x" * 60_000), (13, "unlike any other")]


def test_dedup_equals_a_loop(spark):
    got = exact_dedup.judge(docs(spark, CASES)).collect()
    assert sorted([(r.id, r.keep, r.group_size, r.sha) for r in got], key=str) == judged(CASES)
    kept = {r.id for r in got if r.kept}
    assert kept == {3, 6, 7, 8, 10, 11, 13}


def test_dedup_of_repeated_rows_and_missing_ids_keeps_one(spark):
    rows = [(1, "t u"), (1, "t u"), (1, "t\nu"), (None, "v"), (None, "v"), (2, "v"), (None, "w")]
    got = exact_dedup.judge(docs(spark, rows)).collect()
    assert Counter(r.sha for r in got if r.kept) == Counter({r.sha for r in got})
    assert sorted(r.keep for r in got if r.group_size == 3) == [1, 1, 1, 2, 2, 2]
    assert [(r.keep, r.kept) for r in got if r.group_size == 1] == [(None, True)]


def test_dedup_returns_rows_unchanged(spark):
    rows = [(i, f"text {i % 7}" + " " * i, i, "r") for i in range(40)]
    table = docs(spark, rows, ", sha long, _row string")
    got = exact_dedup.deduplicate(table)
    assert got.columns == table.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows[-7:])


def test_dedup_of_an_empty_table(spark):
    assert exact_dedup.judge(docs(spark, [])).count() == 0
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_BLOCKS, 0])
def test_dedup_with_one_text_in_a_third_of_all_rows(spark, limit, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BLOCKS", limit)
    n = 9000
    table = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "same").when(F.col("id") % 3 == 1, F.concat(F.lit("p"), (F.col("id") % 30).cast("string")))
        .otherwise(F.col("id").cast("string")).alias("text"),
    )
    got = exact_dedup.judge(table).groupBy("group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3000, 3000), (300, 3000, 10), (3000, 3000, 1)]


def test_filter_misses_no_repeat_and_passes_most_lone_rows(spark):
    table = spark.range(20_000).select(F.sha2((F.col("id") % 18_000).cast("string"), 256).alias("sha"))
    blocks = exact_dedup.blocks_for(20_000)
    found = exact_dedup.possibly_repeated(table, exact_dedup.repeated_bits(table, blocks), blocks, True)
    n = found.join(table.groupBy("sha").count(), "sha").groupBy("count", "suspect").agg(F.count("*").alias("n")).collect()
    n = {(r["count"], r.suspect): r.n for r in n}
    assert n[2, True] == 4000 and (2, False) not in n
    assert n[1, True] < 0.04 * 16_000


# ---- Merkle manifest -----------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, arity):
    """(last node, siblings per leaf: list of (left, right) texts per level)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            a = at - at % arity
            paths[k].append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + arity])))
            where[k] = at // arity
        nodes = [h(*nodes[a : a + arity]) for a in range(0, len(nodes), arity)]
    return nodes[0], paths


def tree(rows, arity):
    """{row number: (leaf, subroot, path)}, root; rows of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[1]].append((r[0] is not None, r[0] or 0, h(*map(field, r)), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sub = {s: climb([m[2] for m in sorted(groups[s])], arity) for s in order}
    root, tops = climb([sub[s][0] for s in order], arity)
    out = {}
    for s, top in zip(order, tops):
        for m, path in zip(sorted(groups[s]), sub[s][1]):
            out[m[3]] = (m[2], sub[s][0], path + top)
    return out, root


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, source string, lang string, n_chars long, text string{extra}")


def random_rows(n, seed):
    draw = random.Random(seed)
    text = lambda i: draw.choice([None, "", f"a\nb {i}", "é\n", "same"])
    name = lambda: draw.choice([None, "", "web", "web", "web", "bücher", "Z", "1:a"])
    return [(draw.choice([i, i, i, 7, None]), name(), draw.choice([None, "en"]), i % 5, text(i)) for i in range(n)]


@pytest.mark.parametrize("arity,n", [(3, 1), (3, 2), (3, 70), (2, 41), (4, 70)])
def test_manifest_equals_a_loop(spark, arity, n):
    rows = random_rows(n, n)
    want, root = tree(rows, arity)
    fields = [F.col(c) for c in merkle_manifest.FIELDS]
    made = merkle_manifest.build(
        table(spark, rows), merkle_manifest.leaf(fields), F.col("source"), F.col("doc_id"), ["doc_id"], arity
    )
    assert made.root.hex() == root
    show = lambda leaf, sub, path: (leaf, sub, tuple(path))
    got = Counter(
        show(bytes(r._d).hex(), bytes(r.subroot).hex(), [(bytes(s.l).hex(), bytes(s.r).hex()) for s in r._path])
        for r in made.leaves.collect()
    )
    assert got == Counter(show(*v) for v in want.values())


def test_manifest_query_finds_changed_rows(spark, tmp_path):
    rows = random_rows(60, 3)
    table(spark, rows, "").write.parquet(f"{tmp_path}/documents.parquet")
    want, root = tree(rows, 3)
    expected = Counter()
    for i, r in enumerate(rows):
        leaf, sub, path = want[i]
        hit = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0
        cur = h(*map(field, (*r[:4], r[4] and r[4].replace("\n", "")))) if hit else leaf
        for left, right in path:
            cur = h(left, cur, right)
        expected[(r[0], leaf, sub, root, h(*[x for s in path for x in s]), cur, cur == root)] += 1
    got = merkle_manifest.query(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == expected
    assert any(not k[-1] for k in expected) and any(k[-1] for k in expected)


def test_manifest_of_an_empty_table_and_other_columns(spark):
    fields = [F.col(c) for c in merkle_manifest.FIELDS]
    build = lambda t: merkle_manifest.build(t, merkle_manifest.leaf(fields), F.col("source"), F.col("doc_id"), ["doc_id"])
    empty = build(table(spark, []))
    assert empty.root is None and empty.leaves.count() == 0
    rows = random_rows(20, 5)
    wide = table(spark, [(*r, 1, "x") for r in rows], ", _g long, _path string")
    assert build(wide).root.hex() == tree(rows, 3)[1]


# ---- whitening -----------------------------------------------------------------------------


def dense(vectors):
    """(x rows kept, fit list, eigenvalues, eigenvectors as columns) with numpy."""
    fit = np.array(sorted({tuple(v) for v in vectors}), float)
    centred = fit - fit.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / len(fit))
    return fit, e[::-1], v[:, ::-1]


def embeddings(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{extra}")


def integer(v):
    return [int(np.floor(256 * float(np.float32(c)))) for c in v]


def test_whitening_equals_a_dense_decomposition(spark):
    rows = whitening.usable(spark.read.parquet(f"{SF}/embeddings.parquet"))
    vectors = [r.x for r in rows.collect()]
    fit, e, v = dense(vectors)
    out = whitening.query(spark, SF).collect()
    assert len(out) == 4 * len(vectors) and {r.n for r in out} == {len(fit)}
    by = defaultdict(dict)
    for r in out:
        by[r.component][r.vec_id] = r
    x = {r.id: np.array(r.x, float) for r in rows.collect()}
    sums = fit.sum(0)
    for k in range(4):
        sign = np.sign(next(iter(by[k + 1].values())).whitened)
        first = next(iter(by[k + 1]))
        sign *= np.sign((x[first] - fit.mean(0)) @ v[:, k])
        for key, r in by[k + 1].items():
            want = sign * ((x[key] - fit.mean(0)) @ v[:, k]) / np.sqrt(e[k])
            assert abs(r.whitened - want) < 1e-9
            assert abs(r.explained / (e[k] / e.sum()) - 1) < 1e-10
            assert r.deviation == sum((len(fit) * int(a) - int(b)) ** 2 for a, b in zip(x[key], sums))
    assert {r.identity_error for r in out if r.identity_error > 1e-9} == set()


def test_whitening_drops_broken_vectors_only(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None, 2.0]), (3, [nan, 0.0, 0.0]), (4, [0.0, -inf, 0.0]), (5, []), (6, [1.0, 2.0])]
    good = [(10 + i, [float(np.cos(i)), i % 4 / 3, -0.0 if i % 2 else 0.25]) for i in range(20)]
    good += [(10, good[0][1]), (None, good[3][1])]
    rows = whitening.usable(embeddings(spark, [(*r, 1, "a") for r in bad + good], ", x int, component string"))
    got = [(r.id, r.x) for r in rows.collect()]
    assert sorted(got, key=str) == sorted([(i, integer(v)) for i, v in good], key=str)
    w = whitening.fit_whitening(rows.select("x").distinct())
    fit, e, _ = dense([x for _, x in got])
    assert w.n == len(fit) and np.allclose(w.values, e, rtol=1e-11) and len(w.values) == 3
    assert whitening.apply(rows, w).count() == 3 * 22
    assert whitening.identity_error(rows.select("x").distinct(), w) < 1e-10


@pytest.mark.parametrize("vectors,ranks", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0, 2.0], [1.0, 3.0]], 1)])
def test_whitening_without_variance(spark, tmp_path, vectors, ranks):
    embeddings(spark, list(enumerate(vectors))).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.query(spark, str(tmp_path))
    assert out.count() == ranks * len(vectors)
    assert out.schema["deviation"].dataType.simpleString() == "bigint"


def test_whitening_with_equal_and_dependent_dimensions(spark):
    """Corners of a cube: all eigenvalues fall together; a copied dimension adds a zero."""
    corners = [[float(a), float(b), float(c), float(a)] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    rows = whitening.usable(embeddings(spark, list(enumerate(corners))))
    fit = rows.select("x")
    w = whitening.fit_whitening(fit)
    _, e, _ = dense([integer(c) for c in corners])
    assert np.allclose(w.values, e[:3], rtol=1e-10) and len(w.values) == 3
    assert whitening.identity_error(fit, w) < 1e-10


def test_deviation_is_exact_beyond_doubles_and_null_beyond_longs():
    x = np.array([[10**8, -(10**8)], [3, 4]])
    sums = [int(v) for v in x.sum(0)]
    want = [sum((20 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 20, sums) == want
    assert whitening.deviations(x * 10**3, 20, [10**3 * s for s in sums])[0] is None
