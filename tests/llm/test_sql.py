"""The SQL of the operators that SQL can express, by DuckDB over the same tables."""

import os

import duckdb
import pytest

from loomfield import llm

from test_queries import rows


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM read_parquet('{sf}/{f}')")
    got, want = llm.queries()[name](spark, sf).toPandas(), con.execute(llm.oracle_sql()[name]).df()
    got = got[[c for c in got.columns if c in want.columns]]
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
