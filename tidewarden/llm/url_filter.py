"""URL filter over sorted digest arrays.

A rule names a host, a path prefix and a verdict; it fits its host and all subdomains where the
URL's path starts with the rule's. The longest rule that fits decides. A list of blocked hosts
speaks where no rule fits, and everything else is allowed.

The index holds the 64-bit xxhash of every ``host + path`` in ascending order, next to the full
strings. It is built by Spark: digests are range-partitioned, each task writes one array file, and
all tasks of a query memory-map the files (Spark brings them to every executor). Candidate strings
of a URL (its host's suffixes, then suffix + path prefix) are probed by vectorised binary search,
and a digest found counts only if the stored string is the same.

Defined cases: host and path are empty for a null URL or one without ``://``; then no rule fits and
the URL is allowed; null or empty rule hosts and null verdicts are refused; of equal rules the
blocking one counts; repeated rows get equal rows; an empty table or list is fine; other columns
are not read. The mapped files may be larger than memory; they must fit an executor's disk, and
``MOST_BYTES`` bounds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm.common import pieces, read, written
from tidewarden.session import shared_dir

ALLOW, BLOCK, LISTED, HOST = 0, 1, 2, 3
MOST_BYTES = 8 << 30
# Fixed values: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Parameter: hosts blocked where no rule speaks.
UNWANTED = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
    for top in ("com", "net", "org")
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def digests(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), "uint64", len(strings))


# ---- the index -----------------------------------------------------------------------------


class DigestArray:
    """A memory-mapped file: n, n digests, n verdicts, n + 1 string limits, string bytes."""

    @staticmethod
    def pack(strings: list[bytes], verdicts: list[int]) -> bytes:
        found = digests(strings)
        order = np.argsort(found, kind="stable")
        size = np.array([len(strings[i]) for i in order], "<u8")
        limits = np.concatenate([np.zeros(1, "<u8"), size.cumsum().astype("<u8")])
        parts = [np.array([len(strings)], "<u8"), found[order].astype("<u8"), np.array(verdicts, "<u8")[order], limits]
        return b"".join([*(p.tobytes() for p in parts), *(strings[i] for i in order)])

    def __init__(self, path: str):
        raw = np.memmap(path, "uint8", "r")
        n = int(raw[:8].view("<u8")[0])
        self.keys = raw[8 : 8 + 8 * n].view("<u8")
        self.verdicts = raw[8 + 8 * n : 8 + 16 * n].view("<u8")
        self.limits = raw[8 + 16 * n : 16 + 24 * n].view("<u8")
        self.text = raw[16 + 24 * n :]

    def probe(self, strings: list[bytes], found: np.ndarray, out: np.ndarray) -> None:
        """Set ``out`` to the verdict of every string that is stored here."""
        at = np.searchsorted(self.keys, found)
        live = np.flatnonzero(at < len(self.keys))
        live = live[self.keys[at[live]] == found[live]]
        for i in live:
            k = at[i]
            while k < len(self.keys) and self.keys[k] == found[i]:  # equal digests, other strings
                if self.text[int(self.limits[k]) : int(self.limits[k + 1])].tobytes() == strings[i]:
                    out[i] = self.verdicts[k]
                    break
                k += 1


@lru_cache(maxsize=4)
def mapped(names: tuple[str, ...]) -> list[DigestArray]:
    return [DigestArray(SparkFiles.get(name)) for name in names]


def probe(arrays: list[DigestArray], strings: list[bytes]) -> np.ndarray:
    """Verdict of every string, -1 if it is in no array."""
    found, out = digests(strings), np.full(len(strings), -1, "int64")
    for a in arrays:
        a.probe(strings, found, out)
    return out


class Index:
    """Names of the array files and the lengths of the rules' paths."""

    def __init__(self, names: tuple[str, ...], lengths: tuple[int, ...]):
        self.names, self.lengths = names, lengths


def build_index(rules: DataFrame, unwanted: DataFrame | None = None) -> Index:
    """Digest arrays of rules (host, path, verdict) and blocked hosts (host).

    Each kind of entry has a string of its own: rules ``r host path``, blocked hosts ``u host``,
    and ``h host`` for every host with a rule, so that paths are tried for those only.
    """
    spark = rules.sparkSession
    folder = shared_dir(spark, "url-index")
    if rules.filter("host IS NULL OR host = '' OR verdict IS NULL OR verdict NOT IN ('allow', 'block')").limit(1).count():
        raise ValueError("a rule needs a host and a verdict, allow or block")
    path = F.coalesce("path", F.lit(""))
    number = F.max(F.when(F.col("verdict") == "block", BLOCK).otherwise(ALLOW))
    entries = rules.groupBy(F.concat(F.lit("r"), "host", path).alias("entry")).agg(number.alias("verdict"))
    hosts = rules.select(F.concat(F.lit("h"), "host").alias("entry")).distinct().withColumn("verdict", F.lit(HOST))
    entries = entries.unionByName(hosts)
    if unwanted is not None:
        listed = unwanted.select(F.concat(F.lit("u"), "host").alias("entry")).distinct()
        entries = entries.unionByName(listed.withColumn("verdict", F.lit(LISTED)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, verdicts = [], []
        for b in batches:
            strings += [s.encode() for s in b.column("entry").to_pylist()]
            verdicts += b.column("verdict").to_pylist()
        if strings:
            fs, base = pafs.FileSystem.from_uri(folder)
            fs.create_dir(base, recursive=True)
            name, body = f"digests-{uuid.uuid4().hex}.bin", DigestArray.pack(strings, verdicts)
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(body)
            yield pa.RecordBatch.from_pydict({"name": [name], "bytes": [len(body)]})

    spread = entries.select("*", F.xxhash64("entry").alias("_d")).repartitionByRange("_d").drop("_d")
    files = written(spread.mapInArrow(pack, "name string, bytes long"), "url-files")
    if (files.agg(F.sum("bytes")).first()[0] or 0) > MOST_BYTES:
        raise ValueError(f"the list takes more than {MOST_BYTES} bytes: split it and filter in turn")
    names = tuple(r.name for r in files.orderBy("name").collect())  # one per task that wrote
    for name in names:
        spark.sparkContext.addFile(f"{folder}/{name}")
    lengths = rules.select(F.length(path).alias("n")).distinct().orderBy("n").collect()  # distinct lengths of paths
    return Index(names, tuple(r.n for r in lengths))


# ---- judging -------------------------------------------------------------------------------


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    labels = host.split(".")
    return [s for s in (".".join(labels[i:]) for i in range(len(labels))) if s]


def judge_batch(hosts: list[str], paths: list[str], arrays: list[DigestArray], lengths) -> tuple[list, list, list]:
    """(rule, verdict, listed host) of every URL."""
    # Host suffixes: once per distinct host.
    distinct = sorted(set(hosts))
    tails = [(h, s) for h in distinct for s in suffixes(h)]
    marked = probe(arrays, [b"h" + s.encode() for _, s in tails])
    blocked = probe(arrays, [b"u" + s.encode() for _, s in tails])
    ruled: dict[str, list[str]] = {}
    listed: dict[str, str] = {}
    for (h, s), a, b in zip(tails, marked, blocked):
        if a >= 0:
            ruled.setdefault(h, []).append(s)
        if b >= 0:
            listed.setdefault(h, s)  # the longest
    # Paths: every length that some rule has, once per distinct candidate.
    tries: dict[tuple[str, str], int] = {}
    own: list[list[tuple[str, str]]] = []
    for h, p in zip(hosts, paths):
        mine = [(s, p[:n]) for s in ruled.get(h, ()) for n in lengths if n <= len(p)]
        for x in mine:
            tries.setdefault(x, len(tries))
        own.append(mine)
    verdicts = probe(arrays, [b"r" + (s + p).encode() for s, p in tries])
    rules, out = [], []
    for h, mine in zip(hosts, own):
        fit = [(len(s) + len(p), len(s), s + p, verdicts[tries[s, p]]) for s, p in mine if verdicts[tries[s, p]] >= 0]
        best = max(fit) if fit else None
        rules.append(best[2] if best else None)
        out.append(("allow", "block")[best[3]] if best else "block" if h in listed else "allow")
    return rules, out, [listed.get(h) for h in hosts]


def judge(pages: DataFrame, index: Index, url: str = "url", key: str = "page_id") -> DataFrame:
    """The key, host, path, rule, verdict and listed host of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "path", 4 << 20):
            hosts, paths = part.column("host").to_pylist(), part.column("path").to_pylist()
            rules, verdicts, listed = judge_batch(hosts, paths, mapped(index.names), index.lengths)
            text = [pa.array(x, pa.string()) for x in (rules, verdicts, listed)]
            yield pa.RecordBatch.from_arrays([*part.columns, *text], names=[*part.schema.names, "rule", "verdict", "listed"])

    rows = pages.select(F.col(key), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, listed string")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([*rules], "host string, path string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    unwanted = spark.createDataFrame([(h,) for h in UNWANTED], "host string")
    return judge(read(spark, sf_dir, "pages"), build_index(rule_table(spark), unwanted))


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    hosts = ", ".join(f"('{h}')" for h in UNWANTED)
    under = "(c.host = {0}.host OR ends_with(c.host, '.' || {0}.host))"
    return f"""
    WITH r(host, path, verdict) AS (VALUES {rules}), u(host) AS (VALUES {hosts}),
    c AS (SELECT row_number() OVER () AS k, page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    f AS (SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
        arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM c JOIN r ON {under.format('r')} AND starts_with(c.path, r.path) GROUP BY k),
    l AS (SELECT k, arg_max(u.host, length(u.host)) AS listed FROM c JOIN u ON {under.format('u')} GROUP BY k)
    SELECT page_id, host, path, rule,
      coalesce(f.verdict, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed
    FROM c LEFT JOIN f USING (k) LEFT JOIN l USING (k)"""


QUERIES = {"op7_url_filter": query}
ORACLES = {"op7_url_filter": _sql()}
