"""Compare registered queries with their DuckDB twins, exactly."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, sf_dir: str, build, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = build(spark, sf_dir)
    cols = sorted(df.columns)
    left = _sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    right = _sorted(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; first {left[:2]} vs {right[:2]}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{cols}: {a} vs {b}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tidewarden.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir = argv.pop(0)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in queries:
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                diff = None if queries[name](spark, sf_dir).count() > 0 else "no rows"
        except Exception as exc:  # report and go on with the next query
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok ' if diff is None else 'BAD'} {kind} {time.time() - t:6.2f}s {name}"
              + (f"\n    {diff}" if diff else ""), flush=True)
        bad += diff is not None
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
