"""Run registered queries in Spark and their SQL twins in DuckDB, compare like the driver.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, con, sf_dir: str, names: list[str] | None = None) -> dict:
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s_rows = [tuple(r) for r in sdf.collect()]
            s_cols = sdf.columns
        except Exception as ex:  # noqa: BLE001
            results[name] = ("SPARK-ERROR", repr(ex)[:300])
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(s_rows), round(ts, 2))
            continue
        try:
            rel = con.execute(sqls[name])
            d_cols = [d[0] for d in rel.description]
            d_rows = rel.fetchall()
        except Exception as ex:  # noqa: BLE001
            results[name] = ("SQL-ERROR", repr(ex)[:300])
            continue
        ok_cols = sorted(s_cols) == sorted(d_cols)
        ok_n = len(s_rows) == len(d_rows)
        ok_hash = ok_cols and digest(s_cols, s_rows) == digest(d_cols, d_rows)
        status = "MATCH" if (ok_cols and ok_n and ok_hash) else "DIFF"
        results[name] = (status, len(s_rows), len(d_rows), ok_cols, round(ts, 2))
        if status == "DIFF":
            results[name] += (sorted(s_cols), sorted(d_cols))
    return results


if __name__ == "__main__":
    from tablelens.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, duck(sf_dir), sf_dir, names)
    for k, v in res.items():
        print(k, v)
    bad = [k for k, v in res.items() if v[0] not in ("MATCH", "rows-only")]
    print("SUMMARY", len(res), "queries;", len(bad), "not matching:", bad)
