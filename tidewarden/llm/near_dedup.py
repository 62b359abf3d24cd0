"""Near-duplicates by HyperMinHash signatures, banded registers and exact verification.

A text is lower-cased (A-Z) and cut into words; its set holds the distinct runs of ``words``
words, or the whole sequence if there are fewer. Texts with equal sets are one class. Of a set's
64-bit hashes the first 7 bits choose one of 128 registers, and a register keeps the smallest
rest, compressed to its count of leading zeros and 10 bits behind them (Yu & Weber, "HyperMinHash").

*Candidates.* Runs of registers are hashed to bucket keys; two sets with a key in common are
candidates. Sets that may differ in more than a few elements use 32 runs of 4 registers: at a
similarity of 0.85 the chance to agree nowhere is below 1e-10, at 0.8 below 1e-7. Small sets use
8 or 16 longer runs, so that one common phrase is no key. The smallest, which may differ in one
element only, use the hash of the set and of all sets with one element less: exact.

*Links.* First every member of a bucket is compared with the bucket's centre, the member that
shares most bucket places over all bands. That joins most groups at once, in as many pairs as
members. Buckets whose members are still in different components are then compared across
components, block by block of ``BLOCK`` members, in tasks that see two blocks and return only
the links that join components. A pair comes to the exact test if sizes and the
collision-corrected estimate allow the similarity (five standard errors); the exact test reads
both full sets from the files the first pass wrote. Pairs inside one component are never needed:
they cannot change a component. No bucket has a cap.

A bucket of more than ``BLOCK`` members that stays open (unrelated texts with one common passage)
is first refined by prefix filtering: elements are ordered by how many of these members hold them,
rare ones first, and two sets as similar as the rule asks must share one of the first n - ceil(t n)
+ 1 elements of each. Members meet by such elements only; a passage that all share comes last and
brings none together, so the work follows the members' sizes, not their pairs.

Defined cases: a null, empty or blank text has no set, is linked with nothing and is its own
component; repeated rows are copies of each other; among rows with one id all count, and a null
id is never a component's name unless no member has an id; an empty table gives an empty result;
other columns are not read. Hashes stand for shingles: 64 bits, seeds fixed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.llm.common import discard, free_name, pieces, read, split_words, text_of, written
from tidewarden.llm.components import components
from tidewarden.llm.token_ids import mix
from tidewarden.session import shared_dir

REGISTERS, MANTISSA, RUNS = 128, 10, 32
REST = 57  # bits of a hash behind the register number
BLOCK = 2_000
ERRORS = 5.0
# Expected share of accidental agreements of registers, times 2 ** MANTISSA (fixed value).
COLLISION = 0.169919487159739


@dataclass(frozen=True)
class Rule:
    """Shingle length and similarity as a ratio of whole numbers."""

    words: int = 5
    num: int = 80
    den: int = 100

    def enough(self, shared, union):
        return self.den * shared >= self.num * union

    @property
    def tiny(self) -> int:
        """Largest union of two linked sets that differ in one element at most."""
        u = 1
        while (self.den - self.num) * (u + 1) < 2 * self.den:
            u += 1
        return u


# ---- signatures ----------------------------------------------------------------------------


def shingles(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    n, codes, distinct = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    word = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), "uint64", len(distinct))
    h = word[codes]
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(h) - words + 1), "uint64")
        for i in range(words):
            runs = mix(runs, 7) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(runs)]
    runs = mix(runs, 11)
    at = 0
    for size in n:
        if size >= words:
            yield np.unique(runs[at : at + size - words + 1])
        elif size:
            whole = xxhash.xxh64_intdigest(h[at : at + size].tobytes(), seed=int(size))
            yield np.array([whole], "uint64")
        else:
            yield np.zeros(0, "uint64")
        at += size


def registers(s: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted set: 0 if empty, else leading zeros and mantissa."""
    out = np.zeros(REGISTERS, "uint16")
    place = (s >> np.uint64(REST)).astype("int64")
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(s) else np.zeros(0, "int64")
    low = s[first] & np.uint64((1 << REST) - 1)  # sorted, so the first of a register is its smallest
    bits = np.frexp(low.astype("float64"))[1]
    shift = bits - 1 - MANTISSA
    tail = np.where(shift >= 0, low >> np.maximum(shift, 0).astype("uint64"), low << np.maximum(-shift, 0).astype("uint64"))
    tail = tail & np.uint64((1 << MANTISSA) - 1)
    out[place[first]] = 1 + ((REST - bits).astype("uint64") << np.uint64(MANTISSA)) + tail
    return out


def run_keys(regs: np.ndarray, runs: int) -> np.ndarray:
    """Keys of the runs of registers in every row, 0 where a run is empty."""
    part = regs.view("uint64").reshape(len(regs), runs, -1)
    key = np.full(part.shape[:2], runs, "uint64")
    for column in range(part.shape[2]):
        key = mix(key ^ part[:, :, column], 19)
    return np.where(part.any(axis=2), mix(key + np.arange(runs, dtype="uint64"), 23) | np.uint64(1), 0)


def bucket_keys(s: np.ndarray, regs: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of the buckets a set belongs to, for every union size it can have with a partner."""
    n, most = len(s), len(s) * rule.den // rule.num
    tiny, out = rule.tiny, []
    if n <= tiny:
        whole = np.bitwise_xor.reduce(mix(s, 13))
        out.append(mix(np.append(mix(s, 13) ^ whole, whole), 17) & ~np.uint64(1))
    for runs, low, high in ((8, tiny, 2 * tiny), (16, 2 * tiny, 4 * tiny), (RUNS, 4 * tiny, None)):
        if most > low and (high is None or n <= high):
            key = run_keys(regs[None], runs)[0]
            out.append(key[key > 0])
    return np.concatenate(out)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, registers used) of register rows, corrected for accidental agreement."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    share = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    accidental = used * COLLISION * 4 * share / (1 + share) ** 2 / 2**MANTISSA
    return np.clip((same - accidental) / np.maximum(used, 1), 0, 1), used


def possible(a, b, na, nb, rule: Rule) -> np.ndarray:
    """Pairs that size and estimate do not rule out."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    t = rule.num / rule.den
    found, used = estimate(a, b, na, nb)
    return rule.enough(small, large) & (found >= t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(used, 1)))


SIGNATURE = (
    "row long, doc_id {kind}, tie long, n long, set_a long, set_b long, regs binary, keys array<long>, file string, at long"
)


def signatures(docs: DataFrame, rule: Rule, folder: str) -> DataFrame:
    """One row per document; its sorted set goes to a file of its task in ``folder``."""
    rows = docs.select("doc_id", F.xxhash64(text_of("text")).alias("tie"), text_of("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, at, stream, name = TaskContext.get().partitionId(), 0, 0, None, None
        for part in pieces(batches, "text", 8 << 20):
            if stream is None:
                fs, base = pafs.FileSystem.from_uri(folder)
                fs.create_dir(base, recursive=True)
                name = f"{task:06d}-{uuid.uuid4().hex}"
                stream = fs.open_output_stream(f"{base}/{name}")
            out: dict[str, list] = {k: [] for k in ("n", "set_a", "set_b", "regs", "keys", "at")}
            for s in shingles(part.column("text"), rule.words):
                regs, body = registers(s), s.tobytes()
                digest = xxhash.xxh3_128_digest(body)
                a, b = np.frombuffer(digest, "int64").tolist() if len(s) else (None, None)
                keys = bucket_keys(s, regs, rule).view("int64") if len(s) else np.zeros(0, "int64")
                for k, v in zip(out, (len(s), a, b, regs.tobytes(), keys, at)):
                    out[k].append(v)
                stream.write(body)
                at += len(body)
            m = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + m) + (task << 40)),
                    part.column("doc_id"),
                    part.column("tie"),
                    pa.array(out["n"], pa.int64()),
                    pa.array(out["set_a"], pa.int64()),
                    pa.array(out["set_b"], pa.int64()),
                    pa.array(out["regs"], pa.binary()),
                    pa.array(out["keys"], pa.list_(pa.int64())),
                    pa.array([name] * m, pa.string()),
                    pa.array(out["at"], pa.int64()),
                ],
                names=["row", "doc_id", "tie", "n", "set_a", "set_b", "regs", "keys", "file", "at"],
            )
            row += m
        if stream is not None:
            stream.close()

    signed = rows.mapInArrow(sign, SIGNATURE.format(kind=kind))
    return written(signed.withColumn("file", F.concat(F.lit(f"{folder}/"), "file")), "signatures")


# ---- links ---------------------------------------------------------------------------------


class SetFiles:
    """Reads sets; at most 64 files are open, none after the task."""

    def __init__(self):
        self.open: dict[str, pa.NativeFile] = {}

    def __enter__(self) -> SetFiles:
        return self

    def __exit__(self, *_) -> None:
        for f in self.open.values():
            f.close()
        self.open = {}

    def read(self, uri: str, at: int, n: int) -> np.ndarray:
        f = self.open.pop(uri, None)
        if f is None:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            fs, path = pafs.FileSystem.from_uri(uri)
            f = fs.open_input_file(path)
        self.open[uri] = f  # last used comes last
        return np.frombuffer(f.read_at(8 * n, at), "uint64")


def register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "uint16").reshape(-1, REGISTERS)


def linked(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""

    def side(x: str) -> DataFrame:
        return classes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "regs", "file", "at")])

    rows = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with SetFiles() as files:
            for batch in batches:
                c = {name: batch.column(name) for name in batch.schema.names}
                na, nb = c["n_a"].to_numpy(), c["n_b"].to_numpy()
                ok = possible(register_rows(c["regs_a"]), register_rows(c["regs_b"]), na, nb, rule)
                a, b = c["a"].to_numpy(), c["b"].to_numpy()
                at_a, at_b = c["at_a"].to_numpy(), c["at_b"].to_numpy()
                kept, last, own = [], None, None
                for i in np.flatnonzero(ok):
                    if a[i] != last:
                        last, own = a[i], files.read(c["file_a"][i].as_py(), int(at_a[i]), int(na[i]))
                    other = files.read(c["file_b"][i].as_py(), int(at_b[i]), int(nb[i]))
                    where = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    shared = int((own[where] == other).sum())
                    if rule.enough(shared, int(na[i]) + int(nb[i]) - shared):
                        kept.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], names=["a", "b"])

    # A pair is about 1 kB here; both sets are read where the pair is.
    return rows.select("a", "b", "n_a", "n_b", "regs_a", "regs_b", "file_a", "file_b", "at_a", "at_b").mapInArrow(
        verify, "a long, b long"
    )


def star_pairs(live: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's centre."""
    places = live.groupBy("node").agg(F.sum("members").alias("places"))
    centre = live.join(places, "node").groupBy("bucket").agg(F.max(F.struct("places", "node"))["node"].alias("centre"))
    pairs = live.join(centre, "bucket").filter("node <> centre")
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, from sorted batches."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if held is None else pa.concat_batches([held, batch])
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
        held = batch.slice(cuts[-1])
    if held is not None:
        yield held


class Sets:
    """Full sets of a group's members, read when first needed; a bounded number is held."""

    def __init__(self, g: pa.RecordBatch, files: SetFiles, most: int = 64 << 20):
        self.g, self.files, self.most, self.held, self.bytes = g, files, most, {}, 0

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.held:
            if self.bytes > self.most:
                self.held, self.bytes = {}, 0
            file, at, n = (self.g.column(k)[int(i)].as_py() for k in ("file", "at", "n"))
            self.held[i] = self.files.read(file, at, n)
            self.bytes += 8 * n
        return self.held[i]

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Size of the intersection of member i with each of the others."""
        own, out = self[i], np.zeros(len(others), "int64")
        for a in range(0, len(others), 64):
            some = [self[j] for j in others[a : a + 64]]
            flat = np.concatenate(some)
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            size = np.array([len(x) for x in some])
            out[a : a + 64] = np.add.reduceat((own[at] == flat).astype("int64"), size.cumsum() - size)
        return out


def cross_links(rows: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """Links that join components inside buckets (bucket, members, node, comp, n, regs, file, at).

    A bucket of more than ``block`` members is dealt into blocks, and a task sees two of them at
    a time. It compares signatures of members of different components, reads the sets of those
    that may be similar, and returns the links that join what was apart until then: fewer than
    it has members, whatever the number of pairs. A pair is looked at in the first run of
    registers it has in common only.
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select(
        "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        "own", "node", "comp", "n", "regs", "file", "at",
    )
    rows = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "own", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with SetFiles() as files:
            yield from compare_groups(batches, files)

    def compare_groups(batches: Iterator[pa.RecordBatch], files: SetFiles) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ("bucket", "lo", "hi")):
            bucket, lo, hi = (g.column(k)[0].as_py() for k in ("bucket", "lo", "hi"))
            own, node, comp, n = (g.column(k).to_numpy() for k in ("own", "node", "comp", "n"))
            label = comp.copy()  # components as far as this task knows
            regs, sets, found = register_rows(g.column("regs")), Sets(g, files), []
            runs = run_keys(regs, RUNS)
            here = np.flatnonzero(runs[0].view("int64") == bucket)
            before = int(here[0]) if len(here) else 0
            right = np.flatnonzero(own == hi)
            for i in np.flatnonzero(own == lo):
                others = right[(label[right] != label[i]) & ((right > i) | (lo != hi))]
                if before and len(others):
                    met = (runs[others, :before] == runs[i, :before]) & (runs[i, :before] > 0)
                    others = others[~met.any(axis=1)]
                if len(others):
                    others = others[possible(regs[i], regs[others], n[i], n[others], rule)]
                if not len(others):
                    continue
                shared = sets.shared(i, others)
                for j in others[rule.enough(shared, n[i] + n[others] - shared)]:
                    if label[i] != label[j]:
                        label[label == label[j]] = label[i]
                        found.append((min(node[i], node[j]), max(node[i], node[j])))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def refined(rows: DataFrame, rule: Rule) -> DataFrame:
    """Members of large buckets in buckets of their own, one per rare element (see above).

    Every linked pair of members, of whatever bucket, meets in one of them.
    """
    nodes = written(rows.dropDuplicates(["node"]).select("node", "comp", "n", "regs", "file", "at"), "large-members")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with SetFiles() as files:
            for batch in batches:
                for r in batch.to_pylist():
                    s = files.read(r["file"], r["at"], r["n"]).view("int64")
                    for a in range(0, len(s), 100_000):
                        part = s[a : a + 100_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), r["node"])), pa.array(part)], names=["node", "x"]
                        )

    elements = written(nodes.select("node", "n", "file", "at").mapInArrow(expand, "node long, x long"), "large-elements")
    held = elements.groupBy("x").agg(F.count("*").alias("f")).filter("f > 1")
    listed = elements.join(held, "x").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("xs"))
    listed = listed.join(nodes.select("node", "n"), "node")
    # Elements that no other member holds come first in the order and bring nobody together.
    prefix = F.col("n") - F.ceil(F.col("n") * rule.num / rule.den) + 1 - (F.col("n") - F.size("xs"))
    rare = listed.select("node", F.explode(F.slice("xs", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))).alias("e"))
    rare = rare.select("node", F.col("e.x").alias("bucket")).join(nodes, "node")
    open_ = rare.groupBy("bucket").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return rare.join(open_.filter("lo <> hi").select("bucket", "members"), "bucket").select(
        "bucket", "members", "node", "comp", "n", "regs", "file", "at"
    )


def link_classes(classes: DataFrame, rule: Rule) -> DataFrame | None:
    """node, comp of every class that is linked with another; None if none is."""
    bands = classes.select("node", F.explode(F.array_distinct("keys")).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    live = written(bands.join(shared, "bucket"), "buckets")
    links = written(linked(star_pairs(live), classes, rule), "links")
    comp = None if links.isEmpty() else components(links)
    state = live.withColumn("comp", F.col("node"))
    if comp is not None:
        to = comp.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        state = live.join(to, F.col("node") == F.col("_n"), "left")
        state = state.select("bucket", "members", "node", F.coalesce("_c", "node").alias("comp"))
    open_ = state.groupBy("bucket").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select("bucket")
    facts = classes.select(F.col("node").alias("_n"), "n", "regs", "file", "at")
    rows = state.join(open_, "bucket").join(facts, F.col("node") == F.col("_n")).drop("_n")
    rows = rows.select("bucket", "members", "node", "comp", "n", "regs", "file", "at")
    large = written(rows.filter(F.col("members") > BLOCK), "large-buckets")
    if not large.isEmpty():
        rows = rows.filter(F.col("members") <= BLOCK).unionByName(refined(large, rule))
    more = written(cross_links(rows, rule), "links")
    return comp if more.isEmpty() else components(links.union(more))


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; group (a number of its
    component) and tie (its text's hash) tell apart rows with one id."""
    folder = shared_dir(docs.sparkSession, "shingle-sets")
    signed = signatures(docs, rule, folder)
    sets = signed.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"))
    sets = written(sets, "classes")
    first = sets.select(F.col("node").alias("_node"))
    classes = signed.join(first, F.col("row") == F.col("_node")).select(
        F.col("row").alias("node"), "n", "regs", "keys", "file", "at"
    )
    classes = written(classes, "class-signatures")
    comp = link_classes(classes, rule)
    discard(docs.sparkSession, folder)  # all links are written; nothing reads the sets again
    if comp is None:
        named = sets.select("set_a", "set_b", F.col("node").alias("group"), F.col("low").alias("component_id"))
    else:
        sets = sets.join(comp.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
        sets = sets.select("set_a", "set_b", "low", F.coalesce("comp", "node").alias("group"))
        names = sets.groupBy("group").agg(F.min("low").alias("component_id"))
        named = sets.join(names, "group")
    named = named.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), "group", "component_id")
    some = signed.filter("n > 0").select("doc_id", "tie", "n", "set_a", "set_b")
    some = some.join(named, (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")))
    empty = signed.filter("n = 0").select("doc_id", "tie", "n", F.col("row").alias("group"), F.col("doc_id").alias("component_id"))
    both = some.select("doc_id", "tie", "n", "group", "component_id").union(empty)
    return both.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "group",
        "tie",
    )


def deduplicate(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest id, unchanged.

    Of several rows with that id the one whose text has the smallest hash stays. Rows without a
    set are linked with nothing and all stay.
    """
    found = near_duplicates(docs, rule).filter("kept")
    of, tie, many = free_name(docs, "_of"), free_name(docs, "_tie"), free_name(docs, "_many")
    sets = found.filter("n_shingles > 0").groupBy("group", "doc_id", "tie").agg(F.count("*").alias("rows"))
    sets = sets.groupBy("group").agg(F.min(F.struct("doc_id", "tie", "rows")).alias("x")).select("x.*")
    empty = found.filter("n_shingles = 0").select("doc_id", "tie", F.lit(1).cast("long").alias("rows")).distinct()
    kept = sets.union(empty).select(F.col("doc_id").alias(of), F.col("tie").alias(tie), F.col("rows").alias(many))
    kept = written(kept, "kept")
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64(text_of("text")) == F.col(tie)))
    single = rows.filter(F.col(many) == 1).drop(of, tie, many)
    if kept.filter(F.col(many) > 1).isEmpty():
        return single
    turn = free_name(docs, "_turn")
    number = F.row_number().over(Window.partitionBy("doc_id", tie).orderBy(F.lit(1)))
    several = rows.filter(F.col(many) > 1).withColumn(turn, number).filter(F.col(turn) == 1)
    return single.unionByName(several.drop(of, tie, many, turn))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), Rule(3, 85, 100)).drop("group", "tie")


QUERIES = {"op10_near_dedup": query}
ORACLES: dict[str, str] = {}
