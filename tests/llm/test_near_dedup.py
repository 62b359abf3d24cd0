"""Near-duplicates against all-pairs comparison in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewarden.llm import near_dedup
from tidewarden.llm.common import read
from tidewarden.llm.components import components
from tidewarden.llm.near_dedup import Rule

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, words):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        runs = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
        out[i] = runs or ({tuple(w)} if w else set())
    return out


def plain(rows, rule):
    """doc_id -> (set size, smallest id of its component)."""
    sets = sets_of(rows, rule.words)
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in holders[x] if j < i).items():
            if rule.enough(k, len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows, rule):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, rule)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("rule", [Rule(3, 85, 100), Rule(5, 80, 100)])
def test_documents_of_the_table(spark, rule):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    check(spark, rows, rule)


def copies(rng, size, n, most):
    """A text and n copies with up to ``most`` words changed each."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    yield " ".join(base)
    for _ in range(n):
        w = [*base]
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def test_groups_of_copies_of_every_size(spark):
    rng = random.Random(11)
    rows, at = [], 1000
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 26, 30, 40, 55, 80, 120, 300):
        for text in copies(rng, size, 25, max(1, size // 18)):
            rows.append((at, text))
            at += 1
    rng.shuffle(rows)
    check(spark, rows, Rule(3, 85, 100))
    check(spark, rows, Rule(2, 80, 100))


def test_one_large_group_split_into_blocks(spark, monkeypatch):
    """Copies that are linked through their base only, and a common passage that links nothing."""
    original = near_dedup.cross_links
    monkeypatch.setattr(near_dedup, "cross_links", lambda rows, rule: original(rows, rule, block=16))
    rng = random.Random(4)
    rows = [(i + 50, t) for i, t in enumerate(copies(rng, 90, 220, 5))]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(i + 900, passage + " " + " ".join(f"q{i}_{k}" for k in range(25 + i % 9))) for i in range(150)]
    check(spark, rows, Rule(3, 85, 100))


def test_large_buckets_are_refined_by_rare_elements(spark, monkeypatch):
    """Unrelated texts with one long common passage, pairs of copies among them: few members meet."""
    monkeypatch.setattr(near_dedup, "BLOCK", 30)
    met, original = [], near_dedup.cross_links
    monkeypatch.setattr(near_dedup, "cross_links", lambda rows, rule: (met.append(rows.collect()), original(rows, rule))[1])
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(400):
        own = [f"q{i}_{k}" for k in range(30 + i % 9)]
        rows.append((2 * i, passage + " " + " ".join(own)))
        if i % 10 == 0:
            own[rng.randrange(len(own))] = "changed"
            rows.append((2 * i + 1, passage + " " + " ".join(own)))
    check(spark, rows, Rule(3, 85, 100))
    check(spark, rows, Rule(5, 80, 100))
    for rows_met in met:
        sizes = Counter(r.bucket for r in rows_met)
        assert sum(n * n for n in sizes.values()) < 40 * len(rows)


def test_edges(spark):
    rows = [(None, "a b c d"), (None, None), (7, "A b\tC  d"), (7, "a b c d"), (8, ""), (9, " \n"), (3, "a b"), (4, "A B")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS kept", "3 AS n", "4 AS _tie")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, Rule(3, 85)).collect())
    assert got == [
        ("3", 1, 3, True), ("4", 1, 3, False), ("7", 2, 7, True), ("7", 2, 7, True), ("8", 0, 8, True), ("9", 0, 9, True),
        ("None", 0, None, True), ("None", 2, 7, False),
    ]
    assert near_dedup.near_duplicates(df.limit(0), Rule()).count() == 0
    kept = near_dedup.deduplicate(df, Rule(3, 85))
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "9", "None"]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 40_000, dtype="int64").view("uint64") * np.uint64(2))
    errors = []
    for shared in (0.5, 0.7, 0.85, 0.95):
        for k in range(20):
            part = rng.permutation(pool)[:2000]
            cut = int(2000 * (1 - shared) / 2)
            a, b = np.sort(part[: 2000 - cut]), np.sort(part[cut:])
            n = np.array([len(a)])
            got, _ = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], n, n)
            errors.append(got[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 30)] + [(200, 201), (201, 202), (202, 200)]
    rng.shuffle(links)
    df = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in links], "a long, b long")
    got = {r.node: r.comp for r in components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 30)}, 200: 200, 201: 200, 202: 200}


def test_shingles_of_short_and_empty_texts():
    got = [len(s) for s in near_dedup.shingles(pa.array(["", None, "a", "a b", "a b c", "a b c d", "a a a a"]), 3)]
    assert got == [0, 0, 1, 1, 1, 2, 1]
