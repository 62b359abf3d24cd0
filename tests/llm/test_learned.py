"""Learned operators: against plain recursions and counts, and by held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import language_id, lm_scoring, quality_classifier
from tidewarden.llm.common import read

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PATH = public_tokenizers.path(lm_scoring.MODEL)
EDGES = [(None, None), (None, ""), (-1, " \t"), (-2, "123 !!"), (-3, "x" * 300), (-4, "日本語 テキスト"), (-4, "日本語 テキスト")]


def edges(spark, extra=""):
    rows = [(i, t, None, None, 0) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def all_spellings(word, logp):
    """Sum over all ways to cut a word into pieces, by brute force."""
    lat = lm_scoring.lattice(PATH)
    pieces = {}
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = (lm_scoring.MARK + word).encode()
    for i in range(m.get_piece_size()):
        if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)):
            pieces.setdefault(m.id_to_piece(i).encode(), []).append(i)

    def total(rest):
        if not rest:
            return 1.0
        out = math.exp(logp[lat.byte_piece[rest[0]]]) * total(rest[1:])
        for k in range(1, len(rest) + 1):
            for i in pieces.get(rest[:k], ()):
                out += math.exp(logp[i]) * total(rest[k:])
        return out

    return math.log(total(text))


def test_forward_recursion_sums_all_spellings():
    lat = lm_scoring.lattice(PATH)
    words = ["a", "thé", "ing", "日", "Theor"]
    got = lat.log_prob(pa.array(words), lat.first)
    assert got == pytest.approx([all_spellings(w, lat.first) for w in words], rel=1e-9)


def test_expected_uses_add_up():
    lat = lm_scoring.lattice(PATH)
    for _, m in lat.by_length(pa.array(["things", "orange"])):
        use = lat.expect(m, lat.first)
        # Every spelling covers all bytes exactly once.
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
        size = [1 if sp.is_byte(int(i)) else len(sp.id_to_piece(int(i)).encode()) for i in np.flatnonzero(use)]
        assert (use[np.flatnonzero(use)] * size).sum() == pytest.approx(m.size)


def test_scores_of_all_documents(spark, monkeypatch):
    docs = read(spark, SMALL, "documents").union(edges(spark))
    held = lm_scoring.fold("doc_id", 7) == 2
    got = lm_scoring.score(docs, held, PATH, common=50).collect()
    rows = [(r.doc_id, [w for w in re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(UPPER))]) for r in docs.collect()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(t for i, w in rows if not out(i) for t in [*w, None])
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(i), out(i), len(w) + 1, sum(c[t] > 0 for t in [*w, None]),
         round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in [*w, None]), 6))
        for i, w in rows
    )
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert {r.train_tokens for r in got} == {n}
    # The border between sent and joined words does not matter.
    other = {(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score(docs, held, PATH).collect()}
    assert all(r.score == pytest.approx(other[r.doc_id, r.n_tokens]) and r.score <= 0 for r in got)


def test_lm_without_training_rows(spark):
    docs = edges(spark)
    got = lm_scoring.score(docs, F.lit(True), PATH).collect()
    assert len(got) == len(EDGES) and all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in got)
    assert lm_scoring.score(docs.limit(0), F.lit(False), PATH).count() == 0


def test_long_words_give_what_the_matrix_recursion_gives(monkeypatch):
    lat = lm_scoring.lattice(PATH)
    rng = np.random.default_rng(12)
    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 37)
    for n in (1, 2, 15, 16, 17, 36, 37, 38, 400):
        raw = rng.choice(np.frombuffer(b"abcdeeestrin\xc3\xa9", "uint8"), n)
        want = lat.forward(raw[None], lat.first)[:, 0]
        assert lat._sweep(raw, lat.first, False) == pytest.approx(want, rel=1e-10)
        assert lat._sweep(raw, lat.first, True)[0] == pytest.approx(want[-1], rel=1e-10)
        assert lat.long_expect(raw, lat.first) == pytest.approx(lat.expect(raw[None], lat.first), rel=1e-8, abs=1e-12)


def test_a_word_of_a_megabyte_is_scored_in_seconds():
    import time

    lat, rng = lm_scoring.lattice(PATH), np.random.default_rng(13)
    word = bytes(rng.integers(97, 123, 1_000_000).astype("uint8")).decode()
    t = time.perf_counter()
    (score,) = lat.log_prob(pa.array([word]), lat.first)
    ((_, m),) = lat.by_length(pa.array([word]))
    uses = lat.expect(m, lat.first)
    assert time.perf_counter() - t < 60
    assert -20e6 < score < -1e6 and uses.sum() > 1e5


# ---- language ------------------------------------------------------------------------------


def plain_grams(text):
    n = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = f" {word} "
        n.update(w[1:-1])
        n.update(w[i : i + 2] for i in range(len(w) - 1))
        n.update(w[i : i + 3] for i in range(len(w) - 2))
    code = lambda g: sum(ord(c) << (42 - 21 * i) for i, c in enumerate(g))
    return {code(g): k for g, k in n.items()}


def test_grams_equal_plain_counts():
    texts = ["The cat, the Hat!", "", None, "Été à l'œil 3x", "x", "日本語 ok"]
    for text, (codes, n) in zip(texts, language_id.grams(pa.array(texts))):
        assert dict(zip(codes.tolist(), n.tolist())) == plain_grams(text)
        assert (np.diff(codes) > 0).all()


def test_languages_of_held_out_documents(spark):
    got = language_id.query(spark, LARGER).join(read(spark, LARGER, "documents").select("doc_id", "lang"), "doc_id")
    rows = [r for r in got.collect() if r.held_out]
    assert len(rows) > 250 and sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_profile_is_the_plain_ranking(spark):
    docs = read(spark, SMALL, "documents").filter("lang = 'de'")
    n = Counter()
    for r in docs.collect():
        n.update(plain_grams(r.text))
    want = sorted(n, key=lambda g: (-n[g], g))[:300]
    assert language_id.profiles(docs)["de"].tolist() == want


def test_languages_at_the_edges(spark):
    learned = {"b": np.array([ord("x") << 42]), "a": np.array([ord("y") << 42])}
    docs = edges(spark).selectExpr("*", "1 AS lang_pred", "2 AS score")
    got = language_id.identify(docs, learned, F.lit(False)).collect()
    pred = sorted((str(r.doc_id), r.lang_pred) for r in got)
    assert pred == [("-1", "und"), ("-2", "und"), ("-3", "b"), ("-4", "a"), ("-4", "a"), ("None", "und"), ("None", "und")]
    assert {r.lang_pred for r in language_id.identify(docs, {}, F.lit(False)).collect()} == {"und"}
    assert language_id.profiles(docs.limit(0)) == {}


# ---- quality -------------------------------------------------------------------------------


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(5)
    x = [rng.normal(size=(400, quality_classifier.WIDTH)), rng.normal(1, 2, size=(300, quality_classifier.WIDTH))]
    n = np.array([len(p) for p in x], float)
    model = quality_classifier.Discriminant(n, np.stack([p.sum(0) for p in x]), np.stack([p.T @ p for p in x]))
    q, z = quality_classifier, np.concatenate(x)[::50]
    cov = [np.cov(p.T, bias=True) for p in x]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.sqrt(np.diag(pooled) + q.FLOOR)
    logs = []
    for k in (0, 1):
        s = (1 - q.POOLED - q.DIAGONAL) * cov[k] + q.POOLED * pooled + q.DIAGONAL * np.diag(np.diag(pooled))
        s = s / np.outer(scale, scale) + q.FLOOR * np.eye(len(s))
        d = (z - x[k].mean(0)) / scale
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]))
    odds = logs[1] - logs[0] + math.log(model.prior / (1 - model.prior))
    assert model.score(z) == pytest.approx(1 / (1 + np.exp(-odds)))


def plain_statistics(text):
    """The twelve numbers of one text, counted one character and one word at a time."""
    text = text or ""
    kinds = Counter()
    for c in text:
        if c in " \t\x0b\x0c\r":
            kinds["blank"] += 1
        elif c == "\n":
            kinds["line"] += 1
        elif c in ".,;:!?'\"()-":
            kinds["stop"] += 1
        elif ord(c) > 127:
            kinds["other"] += 1
        elif c.isupper() or c.isdigit() or c.islower():
            kinds["upper" if c.isupper() else "digit" if c.isdigit() else "lower"] += 1
        else:
            kinds["sign"] += 1
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    sizes = [len(w.encode()) for w in words]
    many = max(1, len(words))
    mean = sum(sizes) / many
    windows = list(zip(words, words[1:], words[2:]))
    share = lambda x, y: math.sqrt(x / max(1, y))
    visible = max(1, len(text) - kinds["blank"] - kinds["line"])
    return [
        math.log1p(len(words)), math.log1p(mean), math.log1p(math.sqrt(max(0, sum(n * n for n in sizes) / many - mean**2))),
        *[share(kinds[k], visible) for k in ("upper", "digit", "stop", "sign", "other")],
        share(kinds["line"], many), share(len(set(words)), many),
        share(sum(a == b for a, b in zip(words, words[1:])), many), share(len(windows) - len(set(windows)), many),
    ]


def test_statistics_equal_plain_counts_in_any_company(spark):
    texts = [r.text for r in read(spark, SMALL, "documents").collect()] + [t for _, t in CASES_OF_TEXT]
    together = quality_classifier.statistics(pa.array(texts, pa.string()))
    want = np.array([plain_statistics(t) for t in texts])
    assert np.abs(together - want).max() < 1e-6
    alone = np.vstack([quality_classifier.statistics(pa.array([t], pa.string())) for t in texts[::3]])
    assert (together[::3] == alone).all() or np.abs(together[::3] - alone).max() < 1e-6
    # Repeats: exactly the same number, whatever is beside the text.
    assert (together[::3, -1] == alone[:, -1]).all()


CASES_OF_TEXT = [(1, None), (2, ""), (3, "a"), (4, "a a a a a"), (5, "x y z x y z"), (6, "é É ß, 1 $"), (7, "b " * 3000)]


def test_scores_do_not_depend_on_the_partitioning(spark):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")

    def scores(rows):
        f = quality_classifier.featurise(rows, F.lit(False)).persist()
        model = quality_classifier.fit(f, labels)
        got = quality_classifier.classify(f, model).collect()
        f.unpersist()
        return {r.doc_id: r.score for r in got}

    one, seven, many = scores(docs.coalesce(1)), scores(docs.repartition(7)), scores(docs.repartition(60))
    assert max(abs(one[k] - seven[k]) for k in one) < 1e-9 and max(abs(one[k] - many[k]) for k in one) < 1e-9


def test_quality_of_held_out_documents(spark):
    got = quality_classifier.query(spark, LARGER).join(read(spark, LARGER, "labels"), "doc_id")
    rows = [r for r in got.collect() if r.held_out]
    assert len(rows) > 60 and sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_at_the_edges(spark):
    docs = edges(spark).selectExpr("*", "1 AS label", "2 AS features", "3 AS predicted")
    f = quality_classifier.featurise(docs, F.lit(False))
    none = spark.createDataFrame([(-1, None), (-2, 1), (None, 0)], "doc_id long, quality int")
    got = quality_classifier.classify(f, quality_classifier.fit(f, none)).collect()
    assert len(got) == len(EDGES) and {round(r.score, 6) for r in got} == {round(2 / 3, 6)}
    both = spark.createDataFrame([(-1, 0), (-2, 1), (-4, 1), (-3, 0), (-3, 0)], "doc_id long, quality int")
    got = quality_classifier.classify(f, quality_classifier.fit(f, both)).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.classify(f.limit(0), quality_classifier.fit(f.limit(0), none)).count() == 0
