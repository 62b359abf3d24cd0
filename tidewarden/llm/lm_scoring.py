"""Language-model scores from subword lattices.

The pieces of an existing vocabulary spell a word in many ways. Each piece has a probability; the
probability of a word under the lattice is the sum over all its spellings, got by a forward
recursion in log space over the word's bytes. Byte pieces make every word spellable. The first
probabilities follow the ranks in the vocabulary's scores; ``ROUNDS`` steps of expectation
maximisation over all distinct training words fit them to the corpus.

The document model draws tokens (words with A-Z in lower case, then one end) independently::

    P(w) = max(c(w) - D, 0) / N  +  D * V / N * lattice(w)

with c, N, V the token's count, all tokens and distinct tokens of the training rows: words seen
in training have an arc of their own beside the spellings, and the mass taken from them by the
discount D is spread by the lattice over every possible word. Both parts sum to one together.

Work flow: distinct words per piece of a partition are counted and summed by word, the lattice is
run once per distinct word, and document sums need each word's row. Words that make up at least
1 / ``COMMON`` of all tokens, hence at most ``COMMON`` words, are sent to all tasks; the others
are joined by word, which leaves no hot key. Words beyond ``LONG`` bytes take a recursion of their own
whose work is linear and whose memory is some dozen bytes per byte of the word.

Defined cases: a null or empty text has the end token only; without training rows N = V = 0, the
word's probability is the lattice's and the end's is 1; repeated rows get equal rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import flat_bytes, fold, per_row, pieces, read, split_words, text_of, written

MARK = "▁"
MODEL = "piece_bpe_32k.model"
COMMON = 100_000
DISCOUNT = 0.75
ROUNDS = 3
PRIOR = 0.01
FOLDS, HELD_OUT = 7, 2
LONG, PIECE_BYTES = 2_000, 65_536
LN10 = float(np.log(10.0))


class Lattice:
    """A byte trie over the pieces of a SentencePiece model, and first log probabilities.

    Pieces are numbered by the model's ids. Probability falls with the rank as 1 / (rank + 10),
    the usual shape of word frequencies; byte pieces share the weight of one last rank.
    """

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.byte_piece = np.zeros(256, "int64")
        nodes, piece_of, keys, to = {b"": 0}, [-1], [], []
        weight = np.zeros(n)
        for i in range(n):
            if m.is_control(i) or m.is_unknown(i):
                continue
            if m.is_byte(i):
                self.byte_piece[int(m.id_to_piece(i)[3:5], 16)] = i
                weight[i] = 1.0 / (n + 10) / 256
                continue
            text = m.id_to_piece(i).encode()
            weight[i] = 1.0 / (max(0.0, -m.get_score(i)) % 1e8 + 10)
            for k in range(1, len(text) + 1):
                if text[:k] not in nodes:
                    nodes[text[:k]] = len(nodes)
                    piece_of.append(-1)
                    keys.append(nodes[text[: k - 1]] << 8 | text[k - 1])
                    to.append(nodes[text[:k]])
            piece_of[nodes[text]] = i
        self.goto = np.full(len(nodes) << 8, -1, "int32")
        self.goto[keys] = to
        self.piece_of = np.array(piece_of, "int32")
        self.longest = max(map(len, nodes))
        with np.errstate(divide="ignore"):
            self.first = np.log(weight / weight.sum())

    def starting(self, raw: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all arcs of one word that start at the bytes a to b - 1, by start."""
        at, n = np.arange(a, min(b, len(raw))), len(raw)
        starts, ends, pieces_ = [at], [at + 1], [self.byte_piece[raw[at]]]
        k, state = 0, np.zeros(len(at), "int32")
        while len(at):
            state = self.goto[(state << 8) | raw[at + k]]
            at, state, k = at[state >= 0], state[state >= 0], k + 1
            piece = self.piece_of[state]
            done = piece >= 0
            starts.append(at[done])
            ends.append(at[done] + k)
            pieces_.append(piece[done])
            inside = at + k < n
            at, state = at[inside], state[inside]
        starts, ends, pieces_ = map(np.concatenate, (starts, ends, pieces_))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], pieces_[order]

    def _sweep(self, raw: np.ndarray, logp: np.ndarray, back: bool) -> np.ndarray:
        """Log weight of all spellings up to every byte of one long word, or from it on (``back``).

        Sums are taken as plain numbers, rescaled every few bytes, along the arcs of ``PIECE_BYTES``
        bytes at a time: about a microsecond per byte and little memory.
        """
        n = len(raw)
        sums, shift = np.zeros(n + 1), np.zeros(n + 1)
        open_ = {n if back else 0: 1.0}
        offset = 0.0
        cuts = range(0, n, PIECE_BYTES)
        for a in reversed(cuts) if back else cuts:
            starts, ends, found = self.starting(raw, a, a + PIECE_BYTES)
            b = min(n, a + PIECE_BYTES)
            weight, ends = np.exp(logp[found]).tolist(), ends.tolist()
            first = np.searchsorted(starts, np.arange(a, b + 1)).tolist()
            for i in range(b - 1, a - 1, -1) if back else range(a, b):
                lo, hi = first[i - a], first[i - a + 1]
                if back:
                    value = 0.0
                    for k in range(lo, hi):
                        value += weight[k] * open_[ends[k]]
                    open_[i] = value
                    open_.pop(i + self.longest + 1, None)
                else:
                    value = open_.pop(i)
                    for k in range(lo, hi):
                        end = ends[k]
                        open_[end] = open_.get(end, 0.0) + value * weight[k]
                sums[i], shift[i] = value, offset
                if i % 16 == 0:
                    offset += math.log(value)
                    open_ = {k: v / value for k, v in open_.items()}
        sums[n], shift[n] = (1.0, 0.0) if back else (open_[n], offset)
        return np.log(sums) + shift

    def long_expect(self, raw: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """``expect`` for one long word."""
        alpha, beta, out = self._sweep(raw, logp, False), self._sweep(raw, logp, True), np.zeros(len(logp))
        for a in range(0, len(raw), PIECE_BYTES):
            starts, ends, found = self.starting(raw, a, a + PIECE_BYTES)
            use = np.exp(alpha[starts] + logp[found] + beta[ends] - alpha[-1])
            out += np.bincount(found, use, minlength=len(logp))
        return out

    def arcs(self, m: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, words, pieces) of all arcs that start at byte i of the words in m's rows."""
        n, length = m.shape
        yield i + 1, np.arange(n), self.byte_piece[m[:, i]]
        word, state = np.arange(n), np.zeros(n, "int32")
        for k in range(i, length):
            state = self.goto[(state << 8) | m[word, k]]
            word, state = word[state >= 0], state[state >= 0]
            if not len(word):
                break
            piece = self.piece_of[state]
            ends = piece >= 0
            if ends.any():
                yield k + 1, word[ends], piece[ends]

    def forward(self, m: np.ndarray, logp: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Log weight of all spellings of every prefix: one row per byte position."""
        alpha = np.full((m.shape[1] + 1, m.shape[0]), -np.inf)
        alpha[0] = 0.0
        for i in range(m.shape[1]):
            for end, word, piece in self.arcs(m, i):
                alpha[end, word] = np.logaddexp(alpha[end, word], alpha[i, word] + logp[piece])
                if kept is not None:
                    kept.append((i, end, word, piece))
        return alpha

    def expect(self, m: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece, each word counted once."""
        if m.shape[1] > LONG:
            return sum(self.long_expect(raw, logp) for raw in m)
        kept: list = []
        alpha = self.forward(m, logp, kept)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0.0
        out = np.zeros(len(logp))
        for i, end, word, piece in reversed(kept):
            rest = logp[piece] + beta[end, word]
            beta[i, word] = np.logaddexp(beta[i, word], rest)
            use = np.exp(alpha[i, word] + rest - alpha[-1, word])
            out += np.bincount(piece, use, minlength=len(logp))
        return out

    def by_length(self, words: pa.Array, most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, byte matrix) of words of equal length, the mark in front."""
        raw, limits = flat_bytes(pc.binary_join_element_wise(MARK, words.cast(pa.string()), ""))
        size = np.diff(limits)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for rows in np.split(order, cuts):
            for a in range(0, len(rows), most):
                some = rows[a : a + most]
                if len(some):
                    yield some, raw[limits[some][:, None] + np.arange(size[some[0]])]

    def log_prob(self, words: pa.Array, logp: np.ndarray) -> np.ndarray:
        """Natural log of the lattice probability of every word."""
        out = np.zeros(len(words))
        for rows, m in self.by_length(words):
            if m.shape[1] > LONG:
                out[rows] = [self._sweep(raw, logp, False)[-1] for raw in m]
            else:
                out[rows] = self.forward(m, logp)[-1]
        return out


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (in all rows), c (in rows that are not held out) from text and held_out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", 12 << 20):
            n, codes, words = split_words(pc.ascii_lower(part.column("text")))
            train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), n)
            total = np.bincount(codes, minlength=len(words))
            known = np.bincount(codes[train], minlength=len(words))
            yield pa.RecordBatch.from_arrays([words, pa.array(total), pa.array(known)], names=["word", "n", "c"])

    counted = docs.mapInArrow(count, "word string, n long, c long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probability of every piece after ``rounds`` EM steps over the distinct training words."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, total = lattice(path), None
        for part in pieces(batches, "word", 2 << 20):
            for _, m in lat.by_length(part.column("word")):
                found = lat.expect(m, sent.value)
                total = found if total is None else total + found
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    first = np.exp(lattice(path).first)
    logp = lattice(path).first
    words = words.filter("c > 0").select("word")
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(logp)
        uses = words.mapInArrow(expect, "piece long, uses double")
        rows = uses.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # one row per piece at most
        # A little of the first shape keeps every piece possible.
        weight = first * max(1.0, PRIOR * sum(r.uses for r in rows))
        for r in rows:
            weight[r.piece] += r.uses
        with np.errstate(divide="ignore"):
            logp = np.log(weight / weight.sum())
        sent.destroy()
    return logp


def score(docs: DataFrame, held_out: Column, path: str, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    d = docs.select("doc_id", held_out.alias("held_out"), text_of("text").alias("text"))
    counts = written(word_counts(d), "lm-words")
    words = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("c"),
        F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v"),
    ).first()
    ends = d.filter("not held_out").count()
    n, v = words["c"] + ends, words["v"] + int(ends > 0)
    logp = spark.sparkContext.broadcast(fit_pieces(counts, path))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "word", 2 << 20):
            spelled = lattice(path).log_prob(part.column("word"), logp.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spelled)], names=["word", "n", "c", "spelled"])

    spelled = counts.mapInArrow(weigh, "word string, n long, c long, spelled double")
    share = F.lit(DISCOUNT * v / n if n else 1.0)
    own = F.greatest(F.col("c") - F.lit(DISCOUNT), F.lit(0.0)) / F.lit(float(max(n, 1)))
    # log10(own + share * e^spelled) without leaving log space.
    low = F.log(share) + F.col("spelled")
    both = F.when(own > 0, F.greatest(F.log(own), low) + F.log1p(F.exp(-F.abs(F.log(own) - low)))).otherwise(low)
    table = spelled.select(
        "word",
        "n",
        (F.col("c") > 0).cast("long").alias("known"),
        F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("base"),
        (both / LN10).alias("lp"),
    )
    table = written(table, "lm-table")
    # At most ``common`` words can each make up 1 / common of all words.
    border = max(1, words["all"] // common + 1)
    top = table.filter(F.col("n") >= border).select("word", "known", "base", "lp").toArrow()
    sent = spark.sparkContext.broadcast(
        (pc.cast(top["word"], pa.string()).combine_chunks(), *(top[c].to_numpy() for c in ("known", "base", "lp")))
    )
    end = (
        int(ends > 0),
        float(np.log10((ends + 1) / (n + v + 1))),
        float(np.log10((ends - DISCOUNT) / n)) if ends else (0.0 if not n else float(np.log10(1 / (n + 1)))),
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, *values = sent.value
        task, row = TaskContext.get().partitionId(), 0
        for part in pieces(batches, "text", 6 << 20):
            size, codes, found = split_words(pc.ascii_lower(part.column("text")))
            at = pc.index_in(found.cast(pa.string()), names)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            at = at.fill_null(0).to_numpy()
            doc = [pa.array(np.arange(row, row + len(size)) + (task << 40)), part.column("doc_id"), part.column("held_out")]
            cols = [pa.array(size + 1)]
            for x, e in zip(values, end):
                mine = np.where(hit, x[at], 0) if len(x) else np.zeros(len(hit), x.dtype)
                cols.append(pa.array(per_row(mine[codes], size) + e))
            # The other words, each with its number of times in the document.
            owner = np.repeat(np.arange(len(size)), size)
            rare = ~hit[codes]
            key, times = np.unique(owner[rare] * len(found) + codes[rare], return_counts=True)
            per = np.bincount(key // max(1, len(found)), minlength=len(size))
            limits = pa.array(np.concatenate([[0], per.cumsum()]), pa.int32())
            rest = pa.ListArray.from_arrays(limits, found.take(pa.array(key % max(1, len(found)))))
            cols += [rest, pa.ListArray.from_arrays(limits, pa.array(times))]
            row += len(size)
            yield pa.RecordBatch.from_arrays(
                doc + cols, names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "lp", "words", "times"]
            )

    kind = d.schema["doc_id"].dataType.simpleString()
    part = d.mapInArrow(
        sums,
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, lp double, "
        "words array<string>, times array<long>",
    )
    part = written(part, "lm-docs")
    rare = part.select("row", F.arrays_zip("words", "times").alias("x")).select("row", F.explode("x").alias("x"))
    rare = rare.select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(table.filter(F.col("n") < border).drop("n"), "word").groupBy("row")
    times = F.col("times")
    rare = rare.agg(
        F.sum(times * F.col("known")).alias("known2"),
        F.sum(times * F.col("base")).alias("base2"),
        F.sum(times * F.col("lp")).alias("lp2"),
    )
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return part.drop("words", "times").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        add("known", "known2").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        add("base", "base2").alias("base_score"),
        add("lp", "lp2").alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = fold("doc_id", FOLDS) == HELD_OUT
    return score(read(spark, sf_dir, "documents"), held, public_tokenizers.path(MODEL))


QUERIES = {"op3_lm_scoring": query}
ORACLES: dict[str, str] = {}
