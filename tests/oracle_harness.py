"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

    python tests/oracle_harness.py [sf_dir] [name-substring ...]

Compares row count, column names, a coarse dtype class per column, and
the order-insensitive multiset of normalised rows.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

EXACT = bool(os.environ.get("ORACLE_EXACT"))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2 ** 53:
            return int(v)
        return v if EXACT else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(dtype) -> str:
    s = str(dtype).lower()
    if s in ("float64", "int64", "int32") or s.startswith("int"):
        return "number"
    for k in ("int", "float", "datetime", "bool"):
        if k in s:
            return k
    return "object"


def rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    ddf = con.sql(sql).df()
    t2 = time.time()
    sc, sr = rows(sdf)
    dc, dr = rows(ddf)
    problems = []
    if sc != dc:
        problems.append(f"columns {sc} != {dc}")
    else:
        sk = {c: kind(sdf[c].dtype) for c in sc}
        dk = {c: kind(ddf[c].dtype) for c in dc}
        if sk != dk:
            problems.append(f"dtypes {sk} != {dk}")
    if len(sr) != len(dr):
        problems.append(f"rows {len(sr)} != {len(dr)}")
    elif sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, len(sr), t1 - t0, t2 - t1


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from shopfloor.session import build_session
    import __spark_entry__ as E
    extra = {"spark.sql.session.timeZone": os.environ["ORACLE_TZ"]} if os.environ.get("ORACLE_TZ") else {}
    for kv in filter(None, os.environ.get("ORACLE_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        extra[k] = v
    spark = build_session("local[8]", shuffle_partitions=8, extra=extra)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        if name not in sqls:
            try:
                n = fn(spark, sf_dir).count()
                print(f"NOSQL {name}: {n} rows")
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"ERROR {name}: {type(e).__name__}: {str(e)[:300]}")
            continue
        try:
            problems, n, ts, td = compare(spark, con, name, fn, sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:400]}")
            continue
        if problems:
            bad += 1
            print(f"FAIL  {name}: {'; '.join(problems)[:600]}")
        else:
            print(f"ok    {name}: {n} rows  spark {ts:.2f}s duck {td:.2f}s")
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
