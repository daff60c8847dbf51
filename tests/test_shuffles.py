"""How often order lines move in the plans of marts and checks."""

import pytest
from pyspark.sql import functions as F

from loomfield.operators import marts, quality, staging
from loomfield.plans import retail


def below(df, head):
    """The lines of the optimized plan under each line that holds all of ``head``."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [next((k for k, c in enumerate(x) if c.isalnum()), 0) for x in lines]
    out = []
    for k, x in enumerate(lines):
        if all(h in x for h in head):
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            out.append("\n".join(lines[k + 1 : end]))
    return out


@pytest.fixture(scope="module")
def star(spark, sf):
    return retail._dims(spark, sf, True)


def test_persons_join_orders_not_lines(star):
    joins = below(marts.fact_items(*star), ["Join", "customer_unique_id"])
    assert joins and not any("l_orderkey" in x for x in joins)


def test_lines_are_summed_before_customers_join(spark, star):
    days = spark.createDataFrame([(19950101, 1995, 1, "January")], "date_key int, year_num int, month_num int, month_name string")
    joins = below(marts.revenue_by_month_and_state(marts.fact_items(*star), days, star[1]["customers"]), ["Join", "purchase_date_key"])
    assert joins and all("Aggregate" in x.split("l_orderkey")[0] for x in joins if "l_orderkey" in x)


def test_checks_stage_lines_twice(spark, sf):
    stg = quality.flagged(staging.stage(retail.raw_tables(spark, sf), flagged=True))
    plan = quality.all_checks(stg, F.lit("2024-01-01"))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines()) == 2
