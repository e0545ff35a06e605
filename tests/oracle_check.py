"""Run registered queries next to their oracle SQL and compare values.

    python tests/oracle_check.py [sf] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from pairlab.session import scratch

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            return repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    with scratch(spark):
        df = fn(spark, sf_dir)
        got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows {len(got)} (no oracle)", t1 - t0, 0.0, bool(got)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    a, ca = normal(got, df.columns)
    b, cb = normal(want, want_cols)
    if ca != cb:
        return f"columns differ: {set(ca) ^ set(cb)}", t1 - t0, t2 - t1, False
    if a == b:
        return f"match {len(a)}", t1 - t0, t2 - t1, True
    only = [r for r in a if r not in set(b)][:1], [r for r in b if r not in set(a)][:1]
    detail = ""
    if only[0] and only[1]:
        detail = [(c, x, y) for c, x, y in zip(ca, only[0][0], only[1][0]) if x != y][:4]
    n = len(set(a) ^ set(b))
    return f"MISMATCH {len(a)} vs {len(b)} rows, {n} differ {detail or only}", t1 - t0, t2 - t1, False


def main() -> int:
    import __spark_entry__ as entry
    from pairlab.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        try:
            text, a, b, ok = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as exc:  # report and go on with the other queries
            text, a, b, ok = f"ERROR {str(exc)[:900]}", 0, 0, False
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} spark {a:6.2f}s oracle {b:6.2f}s {text}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
