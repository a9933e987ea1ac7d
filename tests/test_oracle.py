"""Registered queries against their DuckDB oracle on the smallest tables."""
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from classyard.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", ["f11_split_lang", "nearest_centroid_lang", "knn5_evt", "gnb_evt",
                                  "e1_e4_e5_summary", "e9_binary", "a7_combined", "a23_a25_scenarios"])
def test_query_matches_oracle(spark, con, name):
    a = E.queries()[name](spark, SF).toPandas()
    b = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    pd.testing.assert_frame_equal(canon(a), canon(b), check_dtype=False)


def test_every_query_has_a_callable(spark):
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and rows[0]["status"] == "ok"
