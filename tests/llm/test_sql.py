"""Queries with an oracle against DuckDB on the smallest tables."""
import duckdb
import pandas as pd
import pytest

from classyard.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.oracle_sql()[name]).fetchdf()
    got = Q.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)[:2]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)
