"""Run registered Spark queries next to their DuckDB oracle and compare.

Mirrors the driver's check: row count, column names, and an
order-insensitive comparison of values (floats compared after rounding to
6 places). Usable from pytest and as a script:

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = rel.fetchall()
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def compare(spark, name: str, sf_dir: str, queries: dict, oracle: dict, con=None, verbose=True):
    con = con or duck(sf_dir)
    t0 = time.time()
    s_cols, s_rows = rows_of_spark(queries[name](spark, sf_dir))
    t1 = time.time()
    if name not in oracle:
        return {"name": name, "rows": len(s_rows), "oracle": None, "spark_s": t1 - t0}
    o_cols, o_rows = rows_of_duck(con, oracle[name])
    t2 = time.time()
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(o_rows),
           "cols_match": s_cols == o_cols, "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    sa, oa = sorted(s_rows, key=key), sorted(o_rows, key=key)
    res["values_match"] = sa == oa
    if verbose and not (res["cols_match"] and res["values_match"]):
        print("  spark cols:", s_cols)
        print("  duck  cols:", o_cols)
        ss, os_ = set(sa), set(oa)
        only_s = [r for r in sa if r not in os_][:3]
        only_o = [r for r in oa if r not in ss][:3]
        print("  only spark:", [str(r)[:400] for r in only_s])
        print("  only duck :", [str(r)[:400] for r in only_o])
    return res


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from cairn.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(queries())
    spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, orc = queries(), oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, qs, orc, con)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "error": repr(e)[:600]}
        ok = r.get("oracle") is None and "error" not in r and "values_match" not in r or (
            r.get("cols_match") and r.get("values_match"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "FAIL"), r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
