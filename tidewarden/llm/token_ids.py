"""Token ids in binary shards with a minimal perfect hash index.

``write`` tokenises whole texts, sorts documents by id and writes one shard file per range of
ids; ``scan`` reads all shards back in order, finding each stored id's documents through the hash;
``fetch`` gets single documents by key in constant time. Layout of a shard (little-endian)::

    magic 8 bytes | ids of all documents, each with the end id | index | directory | footer of 72 bytes
    index:  ids (i8), null flags (u1), offsets (u8, one more than documents),
            slot -> first document (u4), slot -> documents with that id (u4), slot -> fingerprint (u4),
            per hash level its bits (u8) and the set bits before each word (u4)
    directory: bytes of every part of the index (u8)

Opening a shard reads footer and directory; a key then reads a word and a count per level it is
looked for in, one entry of each slot table, two offsets and its ids, however large the shard.

Ids take two bytes if the vocabulary allows it, four otherwise. The hash (Limasset et al.,
"BBHash") puts every key that is alone in its place of a bit array of that level and sends the
others to the next level; the number of set bits before a key's bit is its slot, so n keys fill n
slots. The fingerprint tells keys that were never stored from those that were.

A task writes to a file name of its own attempt and returns one manifest row; only files in the
written manifest count, so repeated and lost tasks do no harm.

Defined cases: a null or empty text has no ids but the end id; a null id sorts first, is scanned,
and is not in the index; rows with one id are ordered by the hash of their text, and a range of
equal ids can spread over shards; an empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewarden.llm.common import per_row, pieces, read, split_words, text_of, written
from tidewarden.session import shared_dir

MAGIC = b"TWIDS001"
FOOTER = np.dtype(
    [("width", "<u8"), ("end", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("index_at", "<u8"),
     ("index_bytes", "<u8"), ("levels", "<u8"), ("slots", "<u8"), ("magic", "S8")]
)
GAMMA = 2.0
GAP = 4096
SCAN_DOCS, SCAN_IDS = 65_536, 1 << 20
END = 1
MODEL = "word_bpe_49k.json"


# ---- hashing -------------------------------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: a bijection for every seed."""
    with np.errstate(over="ignore"):
        x = keys.astype("uint64") + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Distinct keys -> 0 .. n-1; other keys -> -1 or any slot.

    ``levels`` are (bits, set bits before each word), as arrays or as anything that ``take`` reads.
    """

    def __init__(self, levels: list[tuple]):
        self.levels = levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, total = keys, [], 0
        while len(left):
            words = max(1, int(np.ceil(GAMMA * len(left) / 64)))
            at = mix(left, len(levels)) % np.uint64(words * 64)
            alone = np.bincount(at.astype("int64"), minlength=words * 64)[at.astype("int64")] == 1
            bits = np.zeros(words * 64, "uint8")
            bits[at[alone].astype("int64")] = 1
            packed = np.packbits(bits, bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype("int64")
            levels.append((packed, (total + ones.cumsum() - ones).astype("<u4")))
            total += int(ones.sum())
            left = left[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, "int64"), np.arange(len(keys))
        for k, (bits, before) in enumerate(self.levels):
            if not len(left):
                break
            at = mix(keys[left], k) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype("int64"), at & np.uint64(63)
            held = bits.take(word)
            hit = (held >> bit) & np.uint64(1) == 1
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = before.take(word[hit]).astype("int64") + np.bitwise_count(below)
            left = left[~hit]
        return out


# ---- shards --------------------------------------------------------------------------------


class ShardWriter:
    """Appends documents in key order; ``close`` adds index and footer."""

    def __init__(self, stream, width: int, end: int):
        self.stream, self.dtype, self.end = stream, np.dtype(f"<u{width}"), end
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.ids = 0
        stream.write(MAGIC)

    def add(self, keys: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys.astype("<i8"))
        self.nulls.append(nulls.astype("u1"))
        self.sizes.append(sizes.astype("<u8"))
        self.ids += len(ids)
        self.stream.write(ids.astype(self.dtype).tobytes())

    def close(self) -> dict:
        keys, nulls, sizes = map(np.concatenate, (self.keys, self.nulls, self.sizes))
        offsets = np.concatenate([np.zeros(1, "<u8"), sizes.cumsum().astype("<u8")])
        known = np.flatnonzero(nulls == 0)
        distinct, first, repeats = np.unique(keys[known], return_index=True, return_counts=True)
        table = PerfectHash.build(distinct.view("uint64"))
        slot = table.slots(distinct.view("uint64"))
        by_slot = np.argsort(slot)
        parts = [keys, nulls, offsets, known[first][by_slot].astype("<u4"), repeats[by_slot].astype("<u4")]
        parts += [fingerprint(distinct.view("uint64"))[by_slot]]
        parts += [x for level in table.levels for x in level]
        body = b"".join(x.tobytes() for x in parts)
        body += np.array([x.nbytes for x in parts], "<u8").tobytes()
        footer = np.zeros(1, FOOTER)
        index_at = len(MAGIC) + self.ids * self.dtype.itemsize
        footer[0] = (self.dtype.itemsize, self.end, len(keys), self.ids, index_at, len(body),
                     len(table.levels), len(distinct), MAGIC)
        self.stream.write(body)
        self.stream.write(footer.tobytes())
        some = len(known) > 0
        return {
            "docs": len(keys),
            "ids": self.ids,
            "first_id": int(keys[known[0]]) if some else None,
            "last_id": int(keys[known[-1]]) if some else None,
        }


class Part:
    """A part of the index in the file: entries are read where they are asked for."""

    def __init__(self, file, dtype: str, at: int, size: int):
        self.file, self.dtype, self.at = file, np.dtype(dtype), at
        self.count = size // self.dtype.itemsize

    def __len__(self) -> int:
        return self.count

    def slice(self, a: int, b: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * width, self.at + a * width), self.dtype)

    def take(self, places: np.ndarray) -> np.ndarray:
        """Entries at any places; places that lie within ``GAP`` bytes of each other are read together."""
        if not len(places):
            return np.zeros(0, self.dtype)
        wanted, back = np.unique(places, return_inverse=True)
        cuts = np.flatnonzero(np.diff(wanted) * self.dtype.itemsize > GAP) + 1
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(wanted)]):
            run = self.slice(int(wanted[a]), int(wanted[b - 1]) + 1)
            out.append(run[wanted[a:b] - wanted[a]])
        return np.concatenate(out)[back]


class Shard:
    """A shard file open for scans and keyed reads; only footer and directory are read at once."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        f = np.frombuffer(self.file.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        if bytes(f["magic"]) != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no id shard")
        self.dtype = np.dtype(f"<u{int(f['width'])}")
        self.docs, self.ids = int(f["docs"]), int(f["ids"])
        kinds = ["<i8", "u1", "<u8", "<u4", "<u4", "<u4", *["<u8", "<u4"] * int(f["levels"])]
        end = int(f["index_at"]) + int(f["index_bytes"])
        sizes = np.frombuffer(self.file.read_at(8 * len(kinds), end - 8 * len(kinds)), "<u8").astype("int64")
        starts = int(f["index_at"]) + np.concatenate([[0], sizes.cumsum()[:-1]])
        parts = [Part(self.file, k, int(a), int(n)) for k, a, n in zip(kinds, starts, sizes)]
        self.keys, self.nulls, self.offsets, self.first, self.repeats, self.prints = parts[:6]
        self.hash = PerfectHash(list(zip(parts[6::2], parts[7::2])))

    def payload(self, lo: int, hi: int) -> np.ndarray:
        """The ids lo to hi - 1 of the shard."""
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((hi - lo) * width, len(MAGIC) + lo * width), self.dtype)

    def positions(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of every key; 0 documents for keys not stored."""
        keys = np.asarray(keys, "<i8").view("uint64")
        first, repeats = np.zeros(len(keys), "int64"), np.zeros(len(keys), "int64")
        slot = self.hash.slots(keys)
        some = np.flatnonzero(slot >= 0)
        held = some[self.prints.take(slot[some]) == fingerprint(keys[some])]
        first[held], repeats[held] = self.first.take(slot[held]), self.repeats.take(slot[held])
        return first, repeats

    def documents(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, null flags, starts, ends) of the documents a to b - 1, by way of their keys.

        A key's first document comes from its slot, the document from its place among the rows of
        that key. A document without a key is the next in the file.
        """
        keys, nulls = self.keys.slice(a, b), self.nulls.slice(a, b) == 1
        at = np.arange(a, b)
        known = np.flatnonzero(~nulls)
        if len(known):
            distinct, begin, which = np.unique(keys[known], return_index=True, return_inverse=True)
            first, repeats = self.positions(distinct)
            # Rows of one key lie together and may reach over the limits of the block.
            place = np.arange(len(known)) - begin[which] + np.maximum(0, at[known[begin]] - first)[which]
            if (place >= repeats[which]).any():
                raise ValueError("the index does not hold a stored key")
            at[known] = first[which] + place
        low, high = int(at.min()), int(at.max()) + 1
        offsets = self.offsets.slice(low, high + 1).astype("int64")
        return keys, nulls, offsets[at - low], offsets[at - low + 1]


# ---- tokenising ----------------------------------------------------------------------------


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def closing(path: str) -> np.ndarray:
    """True for ids whose piece closes a run of letters, digits or signs."""
    tok = tokenizer(path)
    out = np.zeros(tok.get_vocab_size(), bool)
    out[[i for piece, i in tok.get_vocab().items() if piece.endswith("</w>")]] = True
    return out


def join_runs(runs: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, "uint32"), *runs]), np.concatenate([np.zeros(0, "int64"), *sizes])


def pick(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs named by ``codes``, one after the other, and their sizes."""
    start, size = (sizes.cumsum() - sizes)[codes], sizes[codes]
    shift = start - (size.cumsum() - size)
    return flat[np.arange(int(size.sum())) + np.repeat(shift, size)], size


def encode_each(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every string, encoded on its own."""
    found = [x.ids for x in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]
    return np.array([i for x in found for i in x], "uint32"), np.array([len(x) for x in found], "int64")


def encode_letters(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of strings of letters, encoded together: each one ends where a closing piece stands."""
    ids = np.array(tokenizer(path).encode(" ".join(words), add_special_tokens=False).ids, "uint32")
    ends = np.flatnonzero(closing(path)[ids])
    if len(ends) != len(words):  # a letter to one Unicode table and not to the other
        return encode_each(words, path)
    return ids, np.diff(ends, prepend=-1)


def encode_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every word. The vocabulary is lower case and parts letters from signs, so words
    are first cut into a core and a tail of signs, of which far fewer are distinct."""
    low = pc.ascii_lower(words)
    core = pc.replace_substring_regex(low, r"[!-/:-@\[-`{-~]+$", "")
    parted = pc.and_(
        pc.match_substring_regex(core, r"[0-9a-zß-öø-ÿ]$"), pc.invert(pc.match_substring(low, "<|"))
    )
    core = pc.if_else(parted, core, low)
    tail = pc.if_else(parted, pc.replace_substring_regex(low, r"^.*[0-9a-zß-öø-ÿ]([!-/:-@\[-`{-~]*)$", r"\1"), "")
    units = pa.concat_arrays([core, tail]).dictionary_encode()
    texts, codes = units.dictionary, units.indices.to_numpy()
    letters = pc.match_substring_regex(texts, r"^\pL+$").to_numpy(zero_copy_only=False)
    order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
    many, runs, sizes = int(letters.sum()), [], []
    for a, b, f in ((0, many, encode_letters), (many, len(order), encode_each)):
        for k in range(a, b, 5_000):
            ids, size = f(texts.take(pa.array(order[k : min(b, k + 5_000)])).to_pylist(), path)
            runs.append(ids)
            sizes.append(size)
    flat, size = join_runs(runs, sizes)
    place = np.empty(len(order), "int64")
    place[order] = np.arange(len(order))
    both = place[codes].reshape(2, -1).T.ravel()  # core, tail, core, tail, ...
    flat, size = pick(flat, size, both)
    return flat, size.reshape(-1, 2).sum(axis=1)


def encode(texts: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """(ids per text, all ids), each text closed by ``end``.

    This vocabulary never joins characters across white space, so every distinct word is
    encoded once and the texts are put together from the words' ids.
    """
    n, codes, words = split_words(texts)
    flat, sizes = encode_words(words, path)
    flat, sizes = np.append(flat, np.uint32(end)), np.append(sizes, 1)
    ids, size = pick(flat, sizes, np.insert(codes, n.cumsum(), len(words)))
    return per_row(size, n + 1), ids


# ---- Spark ---------------------------------------------------------------------------------

MANIFEST = "shard int, path string, docs long, ids long, first_id long, last_id long"


def write(docs: DataFrame, folder: str, vocab_path: str, end: int = END) -> DataFrame:
    """Write all texts as id shards below ``folder``; returns the manifest, one row per shard.

    Ids are ranges of ``spark.sql.shuffle.partitions``; equal ids are told apart by their text's
    hash and a seeded random number, so no run of equal rows has to fit one task.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if max(tokenizer(vocab_path).get_vocab_size(), end + 1) <= 1 << 16 else 4
        fs, base = pafs.FileSystem.from_uri(folder)
        task, out, name = TaskContext.get(), None, ""
        for part in pieces(batches, "text"):
            if out is None:
                name = f"ids-{task.partitionId():06d}-{uuid.uuid4().hex}.bin"
                fs.create_dir(base, recursive=True)
                stream = fs.open_output_stream(f"{base}/{name}")
                out = ShardWriter(stream, width, end)
            sizes, ids = encode(part.column("text"), vocab_path, end)
            key = part.column("doc_id")
            out.add(key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False), sizes, ids)
        if out is not None:
            row = out.close() | {"shard": task.partitionId(), "path": f"{folder}/{name}"}
            stream.close()
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema(
        [("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()),
         ("first_id", pa.int64()), ("last_id", pa.int64())]
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("_tie"), F.rand(1).alias("_any"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_any")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(rows.mapInArrow(shards, MANIFEST), "ids-manifest")


def runs(starts: np.ndarray, ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Documents whose ids lie one after the other, in pieces of about ``most`` ids."""
    part = (ends - starts[0]) // most if len(starts) else starts
    cut = (starts[1:] != ends[:-1]) | (part[1:] != part[:-1])
    edges = np.flatnonzero(cut) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(starts)]))


def scan(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shard files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row["path"])
                for a in range(0, s.docs, SCAN_DOCS):
                    keys, nulls, starts, ends = s.documents(a, min(s.docs, a + SCAN_DOCS))
                    crc = []
                    for x, y in runs(starts, ends, SCAN_IDS):
                        ids = s.payload(int(starts[x]), int(ends[y - 1])).astype("<u4")
                        crc += [zlib.crc32(ids[u - starts[x] : v - starts[x]]) for u, v in zip(starts[x:y], ends[x:y])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=nulls), pa.array(row["base"] + starts), pa.array(ends - starts),
                         pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # One row per shard: the running sum is over the manifest, not over documents.
    base = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")
    jobs = manifest.select("shard", "path", base.alias("base"))
    jobs = jobs.repartitionByRange(max(1, manifest.count()), "shard")
    return jobs.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, ids of the documents with the ids in ``keys``; reads only what it looks up.

    The manifest (one row per shard) goes to all tasks; it must stay under 100 000 shards.
    """
    shards = manifest.filter("first_id IS NOT NULL").orderBy("first_id", "last_id").limit(100_001).collect()
    if len(shards) > 100_000:
        raise ValueError("too many shards for one manifest: write fewer, larger ones")
    sent = spark.sparkContext.broadcast([(r.first_id, r.last_id, r.path) for r in shards])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unique(np.concatenate([np.zeros(0, "<i8"), *[b.column(0).drop_null().to_numpy() for b in batches]]))
        # Shards are in key order: only those from the first key's to the last key's are looked at.
        lasts = [last for _, last, _ in sent.value]
        low = bisect.bisect_left(lasts, wanted[0]) if len(wanted) else len(lasts)
        for first, _, path in sent.value[low:]:
            if first > wanted[-1]:
                break
            here = wanted[np.searchsorted(wanted, first) :]
            here = here[: np.searchsorted(here, lasts[low], "right")]
            low += 1
            if not len(here):
                continue
            s = Shard(path)
            for key, first, n in zip(here, *s.positions(here)):
                for at in range(first, first + n):
                    lo, hi = s.offsets.slice(at, at + 2).astype("int64").tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(key)]), pa.array([s.payload(lo, hi).astype("int64")])], names=["doc_id", "ids"]
                    )

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return wanted.repartitionByRange("doc_id").mapInArrow(found, "doc_id long, ids array<long>")


def encode_table(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """Write ``docs`` as id shards in the shared folder and read them back."""
    import public_tokenizers

    folder = shared_dir(docs.sparkSession, "token-ids")
    return scan(write(docs, folder, vocab_path or public_tokenizers.path(MODEL)))


def query(spark, sf_dir: str) -> DataFrame:
    return encode_table(read(spark, sf_dir, "documents"))


QUERIES = {"op2_token_ids": query}
ORACLES: dict[str, str] = {}
