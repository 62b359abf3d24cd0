"""Token counts and token id shards: against plain greedy matching and whole-text encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidewarden.llm import token_counts, token_ids
from tidewarden.session import shared_dir

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \t\x0b", "the, The!! don't 's x.y.z; 1,000.", "a<|endoftext|>! é́ ſ, K. 日本, ΣΑΣ",
       "x" * 5000, "line\nline\r\nline", "▁ ▁x   ..."]


def greedy(word, vocab):
    text, at, n = token_counts.MARK + word, 0, 0
    while at < len(text):
        for end in range(min(len(text), at + 20), at, -1):
            if text[at:end] in vocab:
                break
        else:
            return None
        at, n = end, n + 1
    return n


def plain_words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def test_automaton_equals_greedy_matching_on_random_vocabularies():
    rng = random.Random(3)
    for _ in range(30):
        vocab = {"▁" * rng.randint(0, 1) + "".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        auto = token_counts.Automaton(sorted(vocab))
        words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
        raw, limits = token_counts.flat_bytes(pa.array(["▁" + w for w in words]))
        assert auto.counts(raw, limits).tolist() == [greedy(w, vocab) or 0 for w in words]


def test_words_of_a_megabyte_are_counted_in_seconds():
    import time

    path = public_tokenizers.path(token_counts.MODEL)
    auto, vocab = token_counts.automaton(path), set(token_counts.vocabulary(path))
    rng = random.Random(6)
    long = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n)) for n in (30_000, 30_001, 1_000_000)]
    words = [*long, "short", long[0] + "\u4e00\ue000" + long[1]]
    raw, limits = token_counts.flat_bytes(pa.array([token_counts.MARK + w for w in words]))
    t = time.perf_counter()
    got = auto.counts(raw, limits).tolist()
    assert time.perf_counter() - t < 20
    assert got == [greedy(w, vocab) or 0 for w in words] and got[-1] == 0 < got[2]


def test_token_counts_of_all_documents(spark):
    docs = token_counts.read(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)], "doc_id long, text string")
    both = docs.union(odd).selectExpr("*", "1 AS n_words", "2 AS n_tokens")
    path = public_tokenizers.path(token_counts.MODEL)
    vocab = set(token_counts.vocabulary(path))
    texts = {r.doc_id: r.text for r in both.collect()}
    got = token_counts.count_tokens(both, path).collect()
    assert len(got) == len(texts)
    for r in got:
        n = [greedy(w, vocab) for w in plain_words(texts[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(n), sum(x or 1 for x in n), n.count(None))


def test_perfect_hash_is_minimal_and_prints_reject_strangers():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**62, 20_000).astype("uint64"))
    table = token_ids.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert len(token_ids.PerfectHash.build(keys[:0]).levels) == 0


@pytest.fixture(scope="module")
def table(spark):
    docs = token_counts.read(spark, SF, "documents").select("doc_id", "text")
    rows = [(-i, t) for i, t in enumerate(ODD, 1)] + [(None, "no id"), (5, "same id"), (5, "same id"), (None, None)]
    return docs.union(spark.createDataFrame(rows, "doc_id long, text string"))


def expected(table):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(token_ids.MODEL))
    return [(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in table.collect()]


def test_shards_hold_every_text_in_order(spark, table):
    want = expected(table)
    manifest = token_ids.write(table, shared_dir(spark, "t"), public_tokenizers.path(token_ids.MODEL))
    got = token_ids.scan(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((k for k, _ in want), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    key = lambda x: (str(x[0]), x[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(
        ((k, *crc(ids)) for k, ids in want), key=key
    )
    # Keyed reads: known ids with all their documents, nothing for strangers.
    asked = spark.createDataFrame([(k,) for k in (0, 5, -1, -6, 10**9, None, 17, 17)], "doc_id long")
    found = sorted((r.doc_id, list(r.ids)) for r in token_ids.fetch(spark, manifest, asked).collect())
    assert found == sorted((k, ids) for k, ids in want if k in (0, 5, -1, -6, 17))


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, file):
        self.file, self.bytes, self.reads = file, 0, 0

    def read_at(self, n, at):
        self.bytes, self.reads = self.bytes + n, self.reads + 1
        return self.file.read_at(n, at)


def shard_of(tmp_path, n, repeats=1):
    """A shard of n keys, every document three ids long."""
    keys = np.repeat(np.sort(np.random.default_rng(n).choice(2**40, n, replace=False)) - 2**39, repeats)
    path = str(tmp_path / f"{n}.bin")
    with pa.OSFile(path, "wb") as stream:
        out = token_ids.ShardWriter(stream, 2, 1)
        for a in range(0, len(keys), 10_000):
            part = keys[a : a + 10_000]
            ids = np.column_stack([np.arange(a, a + len(part)) % 60_000, part % 7, np.ones(len(part))]).astype("uint32")
            out.add(part, np.zeros(len(part), bool), np.full(len(part), 3), ids.ravel())
        out.close()
    return path, keys


def test_a_key_reads_as_little_of_a_large_shard_as_of_a_small_one(tmp_path):
    cost = {}
    for n in (2_000, 200_000):
        path, keys = shard_of(tmp_path, n)
        worst = 0
        for i in range(0, n, n // 50):
            s = token_ids.Shard(path)
            opened = s.file.size()
            s.file = counted = Counted(s.file)
            for part in (s.first, s.repeats, s.prints, s.offsets, *[p for level in s.hash.levels for p in level]):
                part.file = counted
            first, number = s.positions(keys[i : i + 1])
            lo, hi = s.offsets.slice(int(first[0]), int(first[0]) + 2).tolist()
            assert (first[0], number[0], s.payload(lo, hi).tolist()) == (i, 1, [i % 60_000, keys[i] % 7, 1])
            worst = max(worst, counted.bytes)
        cost[n] = worst
        assert opened > 20 * n
    assert cost[200_000] < 400 and cost[200_000] < 2 * cost[2_000]
    strangers = np.setdiff1d(np.arange(5_000), keys)
    assert token_ids.Shard(path).positions(strangers)[1].sum() == 0


def test_scan_goes_through_the_index(tmp_path, monkeypatch):
    path, keys = shard_of(tmp_path, 3_000, repeats=3)
    s = token_ids.Shard(path)
    for a, b in ((0, 9_000), (1, 2), (4_000, 4_001), (17, 8_999)):  # blocks may begin inside a key's rows
        got, _, starts, ends = s.documents(a, b)
        assert (got == keys[a:b]).all() and (starts == 3 * np.arange(a, b)).all() and (ends == starts + 3).all()
    good, here = s.first.take, s.first
    monkeypatch.setattr(here, "take", lambda places: good(places)[::-1])  # a broken slot table shows
    try:
        wrong = (s.documents(0, 9_000)[2] != 3 * np.arange(9_000)).any()
    except ValueError:
        wrong = True
    assert wrong


def test_empty_table_and_other_columns(spark, table):
    path = public_tokenizers.path(token_ids.MODEL)
    assert token_ids.encode_table(table.limit(0), path).count() == 0
    named = table.limit(3).selectExpr("*", "1 AS start", "2 AS _tie", "3 AS _any")
    assert token_ids.encode_table(named, path).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_a_damaged_shard_is_refused(tmp_path):
    (tmp_path / "x.bin").write_bytes(b"0" * 200)
    with pytest.raises(ValueError):
        token_ids.Shard(str(tmp_path / "x.bin"))
