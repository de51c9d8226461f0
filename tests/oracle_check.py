"""Run registered queries in Spark and their oracle SQL in DuckDB; compare like the driver does.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
import math
import os
import sys
import time

import duckdb
import pandas as pd

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

from kickoff.session import get_spark  # noqa: E402
import __spark_entry__ as E  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


STRICT = os.environ.get("STRICT") == "1"


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer():
            return int(v)
        return v if STRICT else round(v, 9)
    if isinstance(v, (list, tuple)) or (hasattr(v, "ndim") and getattr(v, "ndim", 0) > 0):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.date() if v.hour == 0 and v.minute == 0 and v.second == 0 else v.to_pydatetime()
    return v


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for r in df[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in r))
    return cols, sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    ok = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SPARK-ERROR {str(e)[:300]}")
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"{name:24s} rows={len(sp)} (no oracle) {ts:.1f}s")
            continue
        t0 = time.time()
        try:
            dd = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SQL-ERROR {str(e)[:300]}")
            continue
        td = time.time() - t0
        c1, r1 = rows(sp)
        c2, r2 = rows(dd)
        status = "OK" if (c1 == c2 and r1 == r2) else "MISMATCH"
        ok += status == "OK"
        detail = ""
        if c1 != c2:
            detail = f" cols spark-only={sorted(set(c1)-set(c2))} sql-only={sorted(set(c2)-set(c1))}"
        elif len(r1) != len(r2):
            detail = f" rows {len(r1)} vs {len(r2)}"
        elif r1 != r2:
            bad = [(a, b) for a, b in zip(r1, r2) if a != b]
            detail = f" {len(bad)} rows differ; first: {bad[0][0][:12]} vs {bad[0][1][:12]}"
        print(f"{name:24s} {status} rows={len(sp)} spark={ts:.1f}s duck={td:.1f}s{detail}", flush=True)
    print("ok", ok)


if __name__ == "__main__":
    main()
