"""Run registered Spark queries and their DuckDB oracle SQL side by side.

Usage: python tests/oracle_check.py [sf_dir] [key-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        v = round(v, 6)
        return 0.0 if v == 0 else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: repr(t))


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_names = sdf.columns
    t1 = time.time()
    if sql is None:
        return dict(key=key, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    d_names = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    info = dict(key=key, rows=len(s_rows), oracle_rows=len(d_rows), spark_s=round(t1 - t0, 2),
                duck_s=round(t2 - t1, 2))
    if sorted(s_names) != sorted(d_names):
        info.update(ok=False, why=f"columns {sorted(s_names)} vs {sorted(d_names)}")
        return info
    a, b = _rows(s_names, s_rows), _rows(d_names, d_rows)
    if len(a) != len(b):
        info.update(ok=False, why="row count")
        return info
    for x, y in zip(a, b):
        if x != y:
            info.update(ok=False, why=f"first diff spark={x} oracle={y} cols={sorted(s_names)}")
            return info
    info.update(ok=True)
    return info


def main(argv):
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from skycap.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        try:
            info = compare(spark, con, key, fn, sqls.get(key), sf_dir)
        except Exception as e:  # noqa: BLE001
            info = dict(key=key, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        if info.get("ok") is False:
            bad += 1
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
