"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tests/oracle_compare.py [sf_dir] [name-substring ...]
Prints one line per query: rows, schema and order-insensitive value match.
"""
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))
import __spark_entry__ as E  # noqa: E402
from classyard.session import get_spark  # noqa: E402
from classyard.sources.tables import TABLES  # noqa: E402


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        a = fn(spark, sf).toPandas()
        ts = time.time() - t0
        if name not in sql:
            print(f"{name:40s} rows={len(a):7d} (no oracle) spark={ts:.1f}s")
            continue
        t0 = time.time()
        b = con.execute(sql[name]).fetchdf()
        td = time.time() - t0
        same_cols = sorted(a.columns) == sorted(b.columns)
        ok = same_cols and len(a) == len(b)
        if ok:
            ca, cb = canon(a), canon(b)
            try:
                pd.testing.assert_frame_equal(ca, cb, check_dtype=False, check_exact=False, rtol=1e-9, atol=1e-9)
            except AssertionError as e:
                ok = False
                print(str(e)[:400])
        bad += not ok
        print(f"{name:40s} {'OK ' if ok else 'BAD'} rows={len(a)}/{len(b)} cols={same_cols} spark={ts:.1f}s duck={td:.1f}s"
              + ("" if same_cols else f" {sorted(a.columns)} vs {sorted(b.columns)}"))
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
