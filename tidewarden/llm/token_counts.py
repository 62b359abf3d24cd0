"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Every node has a failure link: where to go on once the
greedy longest pieces inside the node's string are cut off, and how many pieces that cuts off
(precomputed). A word is then read once, byte by byte, and its number of pieces comes out
without building one.

Words are what ASCII white space separates. A word is spelled with the vocabulary's word mark in
front; if greedy matching gets stuck it counts as one unknown piece. Each piece of a partition is
reduced to its distinct words, and the automaton steps through all of them side by side.

Defined cases: a null or empty text has no words and no tokens; repeated rows get equal rows; an
empty table gives an empty result; columns other than id and text are not read. Nothing is
shuffled. The vocabulary file is a parameter; its pieces are at most a few hundred thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import flat_bytes, per_row, pieces, read, split_words

MARK = "▁"
MODEL = "piece_bpe_32k.model"
FEW = 64  # words that are stepped one by one


def vocabulary(path: str) -> list[str]:
    """The plain pieces of a SentencePiece model: no control, unknown or byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    return [m.id_to_piece(i) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]


class Automaton:
    """Trie of ``vocab`` with failure links and popped-piece counts."""

    def __init__(self, vocab: list[str]):
        children: list[dict[int, int]] = [{}]
        parents, ends = [(-1, -1)], [False]
        for piece in vocab:
            node = 0
            for byte in piece.encode():
                found = children[node].get(byte)
                if found is None:
                    found = children[node][byte] = len(children)
                    children.append({})
                    parents.append((node, byte))
                    ends.append(False)
                node = found
            ends[node] = bool(node)
        link, popped = [-1] * len(children), [0] * len(children)
        level = list(children[0].values())
        while level:  # breadth first: links of shorter strings are known
            for node in level:
                up, byte = parents[node]
                if ends[node]:
                    link[node], popped[node] = 0, 1
                    continue
                z, cut = link[up], popped[up]
                while z >= 0 and byte not in children[z]:
                    z, cut = link[z], cut + popped[z]
                if z >= 0:
                    link[node], popped[node] = children[z][byte], cut
            level = [c for node in level for c in children[node].values()]
        steps = sorted((node << 8 | byte, to) for node, c in enumerate(children) for byte, to in c.items())
        self.keys = np.array([k for k, _ in steps], "int64")
        self.to = np.array([t for _, t in steps], "int32")
        self.link, self.popped = np.array(link, "int32"), np.array(popped, "int32")

    @cached_property
    def plain(self) -> tuple[dict[int, int], list[int], list[int]]:
        """The same tables for one word at a time; only needed once a word is very long."""
        return dict(zip(self.keys.tolist(), self.to.tolist())), self.link.tolist(), self.popped.tolist()

    def walk(self, data: bytes, state: int) -> tuple[int, int, bool]:
        """(state, pieces popped, whether it got stuck) behind ``data``: a few table reads per byte."""
        steps, link, popped = self.plain
        count = 0
        for byte in data:
            to = steps.get(state << 8 | byte)
            while to is None:
                count += popped[state]
                state = link[state]
                if state < 0:
                    return state, count, True
                to = steps.get(state << 8 | byte)
            state = to
        return state, count, False

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of every state for its byte; -1 where there is none."""
        key = state.astype("int64") << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def counts(self, raw: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Pieces of every string of the flat bytes; 0 where greedy matching gets stuck."""
        size = np.diff(limits)
        order = np.argsort(-size, kind="stable")
        start, size = limits[:-1][order], size[order]
        state, count = np.zeros(len(order), "int32"), np.zeros(len(order), "int64")
        stuck = np.zeros(len(order), bool)
        for i in range(int(size[0]) if len(size) else 0):
            live = np.flatnonzero(~stuck[: np.searchsorted(-size, -i, "left")])
            if len(live) <= FEW:  # side by side no longer pays: the longest words go on alone
                for k in live.tolist():
                    rest = raw[start[k] + i : start[k] + size[k]].tobytes()
                    state[k], n, stuck[k] = self.walk(rest, int(state[k]))
                    count[k] += n
                break
            byte = raw[start[live] + i].astype("int64")
            while len(live):
                to = self.step(state[live], byte)
                ok = to >= 0
                state[live[ok]] = to[ok]
                live, byte = live[~ok], byte[~ok]
                count[live] += self.popped[state[live]]
                state[live] = self.link[state[live]]
                dead = state[live] < 0
                stuck[live[dead]] = True
                live, byte = live[~dead], byte[~dead]
        live = np.flatnonzero(~stuck & (state != 0))
        while len(live):  # what is left of each word
            count[live] += self.popped[state[live]]
            state[live] = self.link[state[live]]
            stuck[live[state[live] < 0]] = True
            live = live[state[live] > 0]
        count[stuck] = 0
        out = np.empty(len(order), "int64")
        out[order] = count
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def count_tokens(docs: DataFrame, vocab_path: str, mark: str = MARK) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocab_path)
        for part in pieces(batches, "text"):
            n, codes, words = split_words(part.column("text"))
            raw, limits = flat_bytes(pc.binary_join_element_wise(mark, words, ""))
            found = a.counts(raw, limits)
            unknown = per_row((found == 0).astype("int64")[codes], n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(per_row(np.maximum(found, 1)[codes], n)), pa.array(unknown)],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op1_token_counts": query}
ORACLES: dict[str, str] = {}
