"""Every query with SQL against DuckDB over the same tables."""

import datetime
import decimal
import numbers
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from loomfield.plans import catalogue

NAMES = sorted(catalogue.oracle_sql())


def cell(v):
    if isinstance(v, (list, tuple, dict)):
        return str(v)
    if v is None or pd.isna(v):
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (numbers.Number, decimal.Decimal)):
        return f"{float(v):.6f}"
    return str(pd.Timestamp(v)) if isinstance(v, datetime.date) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, db, name):
    got, want = catalogue.queries()[name](spark, sf).toPandas(), db.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_part(tmp_path):
    """The rest stands alone: without the subpackage the entry imports and lists the other queries."""
    root = Path(__file__).resolve().parent.parent
    for x in ("loomfield", "__spark_entry__.py", "corpus_pipeline.py"):
        of = root / x
        (shutil.copytree if of.is_dir() else shutil.copy)(of, tmp_path / x)
    shutil.rmtree(tmp_path / "loomfield" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n = len(catalogue.queries())
    assert run().stdout.split() == [str(n), str(n), "False"]
    (tmp_path / "loomfield" / "llm" / "__pycache__").mkdir(parents=True)
    assert run().stdout.split() == [str(n), str(n), "False"]
    (tmp_path / "corpus_pipeline.py").unlink()
    assert run().stdout.split() == [str(n), str(n), "False"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_and_push_down(spark, sf):
    p = plan(catalogue.queries()["scan_project_filter"](spark, sf))
    assert "PushedFilters: [IsNotNull" in p and "l_comment" not in p and "l_shipdate" not in p
    assert "WindowGroupLimit" in plan(catalogue.queries()["dedup_nulls_last"](spark, sf))
    assert "TakeOrderedAndProject" in plan(catalogue.queries()["topk_customers"](spark, sf))
    assert "LeftAnti" in plan(catalogue.queries()["anti_not_exists"](spark, sf))
    assert not any("CartesianProduct" in plan(q(spark, sf)) for n, q in catalogue.queries().items() if "join" in n)
