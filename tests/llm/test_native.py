"""Operators that are SQL alone: against their SQL twins, and on rows at the edges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, duck
from tidewarden.llm import decontaminate, mixing, quality_rules, url_filter
from tidewarden.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string, source string{extra}")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- quality rules -------------------------------------------------------------------------


def test_rules_count_repeats_lines_and_signs(spark):
    line = "a b c d e f g"
    got = by_id(
        quality_rules.judge(
            docs(
                spark,
                [
                    (1, f"{line}\n{line}\n \n{line}", None),
                    (2, "x # y\x0b$$ z", None),
                    (3, "a b c d e a b c d e", None),
                    (4, "a b c d e", None),
                    (5, "w " * 12, None),
                ],
            )
        )
    )
    assert (got[1].n_words, got[1].n_dup_lines, got[1].n_repeat_words, got[1].n_lines) == (21, 2, 21, 3)
    assert (got[2].n_words, got[2].n_symbols, got[2].word_chars) == (5, 3, 6)
    # The window "a b c d e" is there twice: both places, all ten words.
    assert (got[3].n_repeat_words, got[4].n_repeat_words) == (10, 0)
    assert got[5].n_repeat_words == 12 and got[5].base_failed


def test_shares_judge_only_texts_they_can_say_something_about(spark):
    words = [f"wort{i}" for i in range(30)]
    rows = [
        (1, " ".join(words[:12]), None),  # too short to miss stop words
        (2, " ".join(words), None),
        (3, " ".join([*words, "(Den,", "der."]), None),  # signs around words do not hide them
        (4, "eins zwei drei vier f\neins zwei drei vier f", None),  # two equal lines of two
        (5, "\n".join(["some words that make one line of text"] * 2 + ["the other line is made of these"] * 3), None),
    ]
    got = by_id(quality_rules.judge(docs(spark, rows)))
    assert (got[1].broken, got[2].broken, got[3].broken) == ([], ["stop_word_share"], [])
    assert got[3].n_stop_words == 2 and got[4].broken == [] and got[5].broken == ["duplicate_line_share"]


def test_rules_on_missing_empty_and_repeated_rows(spark):
    rows = [(None, None, None), (1, "", "s"), (1, "", "s"), (2, " \t\n", "s")]
    got = quality_rules.judge(docs(spark, rows)).collect()
    assert len(got) == 4 and all(r.n_words == 0 and r.base_failed and not r.kept for r in got)
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_keep_good_leaves_rows_as_they_are(spark):
    good = "the cat and the dog went to the old house by the river."
    long = " ".join(f"the w{i}x of v{i}y" for i in range(3000))
    df = docs(spark, [(1, good, "a"), (2, "too short", "a"), (None, good, None), (3, long, "b")])
    df = df.withColumnRenamed("source", "_row").selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS `_text`")
    got = quality_rules.keep_good(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3]


# ---- mixing --------------------------------------------------------------------------------


def test_budgets_stop_at_three_times_and_share_the_rest(spark):
    sizes = spark.createDataFrame(
        [("a", 10), ("b", 1000), ("c", 100), (None, 50), ("z", 0)], "source string, source_size long"
    )
    got = {r.source: r.target for r in mixing.budgets(sizes).collect()}
    # By name, null last: a 5, b 2, c 1, z 5, null 2; a 30, z 0 and null 150 are at their limits.
    assert got["a"] == 30 and got["z"] == 0 and got[None] == 150
    # c reaches its limit too, so all the rest is b's.
    assert got["c"] == 300 and got["b"] == 680
    assert sum(got.values()) == pytest.approx(1160)
    assert all(got[r.source] <= 3 * r.source_size + 1e-9 for r in sizes.collect())


def test_mix_comes_near_targets_and_never_above_three(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 11 else None) for i in range(3000)]
    rows += [(-i, "x $ y", "tiny") for i in range(1, 6)]
    df = docs(spark, rows)
    plan = mixing.plan(df).collect()
    assert len(plan) == len(rows)
    for source in {r.source for r in plan}:
        mine = [r for r in plan if r.source == source]
        taken = sum(r.size * (r.epochs + r.in_part) for r in mine)
        assert abs(taken - mine[0].target) <= max(r.size for r in mine)
        assert all(r.epochs + r.in_part <= 3 for r in mine)
    again = {(r.doc_id, r.in_part) for r in mixing.plan(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.in_part) for r in plan}
    # The rows taken are those of the plan.
    copies = {}
    for r in mixing.take(df).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.epochs + r.in_part for r in plan if r.size and r.epochs + r.in_part}


def test_mix_prefers_good_documents(spark):
    rows = [(i, "word " * 5 if i % 2 else "$$$$ " * 5, "s") for i in range(4000)]
    rows += [(10_000 + i, "word " * 5, "t") for i in range(800)]
    cut = [r for r in mixing.plan(docs(spark, rows), weights=(1, 9)).collect() if r.source == "s" and r.in_part]
    assert sum(r.doc_id % 2 for r in cut) > 0.7 * len(cut)


def test_mix_on_missing_and_empty(spark):
    df = docs(spark, [(None, None, None), (None, "a b", None), (1, "", "s"), (1, "", "s")])
    got = mixing.plan(df).collect()
    assert sorted(r.size for r in got) == [0, 0, 0, 2]
    assert [r.text for r in mixing.take(df).collect()] == ["a b"]
    assert mixing.plan(docs(spark, [])).count() == 0 and mixing.take(docs(spark, [])).count() == 0
    named = df.selectExpr("*", "1 AS key", "2 AS _row", "3 AS _epochs", "4 AS size")
    assert mixing.take(named).columns == named.columns


def test_a_source_of_poor_quality_and_equal_ids_spreads_over_tasks(spark):
    """All rows of one source, mostly signs, a third of them with one id and text."""
    n = 6000
    text = F.when(F.col("id") % 3 == 0, "## $$ x").otherwise(F.concat(F.lit("#### **** "), F.col("id").cast("string")))
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.plan(df, weights=(1,)).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == n and len({r.p for r in got}) >= 4
    assert {(r.source_size, r.target, r.epochs) for r in got} == {(sum(r.size for r in got), float(sum(r.size for r in got)), 1)}


# ---- decontamination -----------------------------------------------------------------------

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def items(spark, *texts):
    return spark.createDataFrame([*enumerate(texts)], "item_id long, text string")


def found(spark, texts, *items_):
    df = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    return {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, items(spark, *items_)).collect()}


def test_leaks_with_substitutions_case_and_signs(spark):
    words = ITEM.split()
    one = [*words]
    one[5] = "changed"
    two = [*words]
    two[3], two[11] = "x", "y"
    many = [w if i % 2 else "z" for i, w in enumerate(words)]
    filler = " ".join(f"f{i}" for i in range(700))
    texts = [
        ITEM,
        f"{filler} {ITEM.upper().replace(' ', ', ')}! {filler}",
        "pre " + " ".join(one),
        "\n".join(two) + " post",
        " ".join(many),
        filler,
        None,
        "",
    ]
    assert found(spark, texts, ITEM) == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_leaks_at_every_place_of_a_block(spark):
    tail = " ".join(f"g{i}" for i in range(300))
    texts = [" ".join(f"f{i}" for i in range(n)) + f" {ITEM} {tail}" for n in range(236, 262)]
    assert len(found(spark, texts, ITEM)) == len(texts)


def test_short_items_and_empty_tables(spark):
    assert found(spark, ["say alpha beta gamma delta epsilon now", "alpha beta gamma"], "alpha beta gamma delta epsilon") == {(0, 0)}
    assert found(spark, ["a b c d", "x"], "a b c d", None, "") == set()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs(spark, [(1, ITEM, None)]), empty).count() == 0
    assert decontaminate.overlaps(docs(spark, []), items(spark, ITEM)).count() == 0


def aligned(text, item):
    """Whether any window of the item, laid at any place of the text, agrees to the share."""
    a, b = text.split(), item.split()
    n = len(b)
    ends = [(0, n)] if n < 12 else [(max(0, p - 2), min(n, p + 14)) for p in range(n - 11)]
    same = lambda s, lo, hi: sum(0 <= j + s < len(a) and a[j + s] == b[j] for j in range(lo, hi))
    return n >= 5 and any(same(s, lo, hi) >= 0.8 * (hi - lo) for s in range(-n, len(a)) for lo, hi in ends)


def test_leaks_with_changes_at_any_place(spark):
    rng = random.Random(7)
    base, texts = [f"t{i}" for i in range(24)], []
    for n in (*range(5, 17), 20, 24):
        most = 1 if n < 10 else 2 if n < 15 else 3
        for k in range(1, most + 2):
            places = list(itertools.combinations(range(n), k))
            for hit in rng.sample(places, min(len(places), 120)):
                words = [f"x{i}" if i in hit else w for i, w in enumerate(base[:n])]
                texts.append((n, " ".join(["before", *words, "after"])))
    wanted = [" ".join(base[:n]) for n in (*range(5, 17), 20, 24)]
    # Each item against its own texts only: the items share their words.
    by_size = {n: item for n, item in zip((*range(5, 17), 20, 24), wanted)}
    own = lambda text, n: " ".join(f"{w}n{n}" for w in text.split())
    got = found(spark, [own(t, n) for n, t in texts], *[own(by_size[n], n) for n in by_size])
    assert {i for i, _ in got} == {i for i, (n, t) in enumerate(texts) if aligned(t, by_size[n])}


def test_beyond_the_broadcast_limit_the_rows_are_the_same(spark, monkeypatch):
    texts = [ITEM, f"a {ITEM} b", "nothing here"]
    want = found(spark, texts, ITEM)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert found(spark, texts, ITEM) == want == {(0, 0), (1, 0)}


def written_by_shuffles(spark):
    """Bytes of all shuffles so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_beyond_the_broadcast_limit_the_shuffle_stays_near_the_text(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    text = rows.selectExpr("sum(octet_length(text))").first()[0]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = written_by_shuffles(spark)
    try:
        n = decontaminate.overlaps(rows, bench).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    used = written_by_shuffles(spark) - before
    assert n > 0 and used < 20 * text, used / text


def test_items_of_few_tokens_match_whole_documents(spark):
    texts = ["A, b!", "a b", "a b c", None, "", "x", "x"]
    df = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = decontaminate.overlaps(df, items(spark, "a b", "X", "", None, "a b c d"), tiny=True)
    assert sorted((r.doc_id, r.item_id, r.overlap, r.hits, r.first_pos) for r in got.collect()) == [
        (0, 0, 1.0, 1, 0), (1, 0, 1.0, 1, 0), (5, 1, 1.0, 1, 0), (6, 1, 1.0, 1, 0)
    ]


def test_the_best_share_counts_over_all_masks(spark):
    """A changed copy that one fixed mask still hits early, and a whole copy further on."""
    words = ITEM.split()
    changed = [*words]
    changed[2], changed[13] = "x", "y"
    df = docs(spark, [(0, " ".join([*changed, "between", *words]), None)])
    (r,) = decontaminate.overlaps(df, items(spark, ITEM)).collect()
    assert r.overlap == 1.0 and r.first_pos < 16 < r.hits


def test_remove_handles_null_ids_and_clashing_names(spark):
    df = docs(spark, [(None, ITEM, "a"), (1, "clean text", "a"), (1, "clean text", "a"), (2, ITEM, "b")])
    df = df.selectExpr("*", "1 AS _leaked", "2 AS item_id", "3 AS _tokens")
    got = decontaminate.remove(df, items(spark, ITEM))
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == [1, 1]


# ---- URL filter ----------------------------------------------------------------------------


def test_url_rules_longest_wins(spark):
    urls = [
        "http://a.b.example.net/en/x?q", "https://example.net/de/", "http://Sub.Example.COM/de/1#t", "http://notexample.com/de/",
        "http://x.org/fr/", "http://x.org/en/", "http://www.adult-x.example.org/en/1", "http://y.net", "no scheme", None, "",
        "a://b://c/d", "x://free-bets.example.com/de/?z",
    ]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    unwanted = spark.createDataFrame([(h,) for h in url_filter.UNWANTED], "host string")
    index = url_filter.build_index(url_filter.rule_table(spark), unwanted)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, index).collect()}
    assert got[0] == ("a.b.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block")
    assert got[2] == ("sub.example.com", "/de/1", "example.com/de/", "block")
    assert got[3][2:] == (None, "allow") and got[4][2:] == ("org/fr/", "allow") and got[5][2:] == (None, "allow")
    assert got[6][2:] == (None, "block") and got[7] == ("y.net", "", None, "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow")
    assert got[11][:2] == ("b:", "//c/d") and got[12][2:] == ("example.com/de/", "block")


def test_url_collisions_and_empty_lists(spark, monkeypatch, tmp_path):
    # With one digest for all strings the stored strings alone decide.
    import numpy as np

    monkeypatch.setattr(url_filter, "digests", lambda s: np.ones(len(s), "uint64"))
    path = tmp_path / "a.bin"
    path.write_bytes(url_filter.DigestArray.pack([b"ra/", b"rb/", b"ha"], [1, 0, 3]))
    array = url_filter.DigestArray(str(path))
    assert url_filter.probe([array], [b"rb/", b"ra/", b"rc/"]).tolist() == [0, 1, -1]
    monkeypatch.undo()
    none = url_filter.build_index(url_filter.rule_table(spark, []))
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge(pages, none).first().verdict == "allow"
    with pytest.raises(ValueError):
        url_filter.build_index(url_filter.rule_table(spark, [("", "/", "block")]))
