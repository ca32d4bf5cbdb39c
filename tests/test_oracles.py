"""Every query that has a DuckDB twin gives the same rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from crawlgrain.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    return sorted(tuple("\0" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = plain(df.select(*columns).collect())
    sql = ORACLES[name]
    there = duck.sql(sql)
    assert sorted(there.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert found == plain(duck.sql(f"select {quoted} from ({sql})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
