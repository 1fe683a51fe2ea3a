"""Runs a registered query on Spark and its SQL on DuckDB, and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _files(root: str, table: str) -> str:
    path = f"{root}/{table}.parquet"
    return f"{path}/*.parquet" if os.path.isdir(path) else path


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{_files(root, t)}'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return {True: "true", False: "false", None: "null"}[v]
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    return str(v)


def rows(columns, data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, root) -> str:
    """'' if both agree, else what differs."""
    df = fn(spark, root)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got[1] else "no rows"
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        odd = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:2]
        return f"{len(got[1])} rows vs {len(want[1])}; first differing: {odd}"
    return "" if got[1] else "agree but no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from sparkward.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    root = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(root)
    fns, sqls = e.queries(), e.oracle_sql()
    only_modules = [w[1:] for w in wanted if w.startswith("@")]
    names = [
        n for n, f in fns.items()
        if not wanted or n in wanted or any(f.__module__.endswith(m) for m in only_modules)
    ]
    bad = 0
    for n in names:
        t = time.time()
        try:
            why = compare(spark, con, n, fns[n], sqls.get(n), root)
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {n} {time.time() - t:.1f}s {why[:1500]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
