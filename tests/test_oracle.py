"""Each query with SQL gives the same rows in Spark and in DuckDB."""

import os

import duckdb
import pytest

from slidemill.queries import SQL, Q
from tools_oracle import norm


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    df = Q[name](spark, sf)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert norm(df.collect(), df.columns) == norm(want.fetchall(), want.columns)
