"""The operators' queries that SQL expresses give the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

from crawlgrain.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    there = con.sql(queries.oracle_sql()[name])
    assert sorted(there.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(con.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())
