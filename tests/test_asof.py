"""The as-of sweep against brute force: hot keys, slices, nulls, empty tables and columns of the same names."""

import bisect
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from loomfield.operators import rows as R

FACT = "f long, k string, d date, extra string"
DIM = "nk string, v long, start_date date, end_date date"
DAY0 = date(2000, 1, 1)


def day(n):
    return DAY0 + timedelta(n)


def brute(facts, dim, how):
    out = []
    for f, k, d, _ in facts:
        hits = [v for nk, v, s, e in dim if k is not None and d is not None and nk == k and s is not None and s <= d and (e is None or e > d)]
        out += [(f, v) for v in hits] or ([(f, None)] if how == "left" else [])
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    dim, facts, n = [], [], 0
    for k in ("hot", "warm", "a", "b"):
        starts = sorted({rng.randrange(0, 900) for _ in range(120 if k == "hot" else 6)})
        for s, e in zip(starts, [*starts[1:], None]):
            dim.append((k, n, day(s), None if e is None else day(e if rng.random() < 0.8 else max(s, e - 1))))
            n += 1
    dim += [("a", 900, None, None), (None, 901, day(1), None), ("b", 902, day(950), day(950)), ("only", 903, day(0), None)]
    for f in range(3000):
        k = rng.choices(["hot", "warm", "a", "b", "none", None], [60, 20, 8, 8, 2, 2])[0]
        facts.append((f, k, None if rng.random() < 0.02 else day(rng.randrange(-5, 1000)), "x"))
    return facts, dim


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("slice_bytes", [0, 1 << 40])
def test_same_as_brute_force(spark, how, slice_bytes):
    facts, dim = cases()
    got = R.as_of(spark.createDataFrame(facts, FACT), spark.createDataFrame(dim, DIM), {"k": "nk"}, F.col("d"), how, slice_rows=50, slice_bytes=slice_bytes)
    assert got.columns == ["f", "k", "d", "extra", "nk", "v", "start_date", "end_date"]
    assert sorted(((r.f, r.v) for r in got.collect()), key=str) == brute(facts, dim, how)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_empty_tables(spark, how):
    facts, dim = spark.createDataFrame([(1, "a", day(3), None)], FACT), spark.createDataFrame([("a", 7, day(1), None)], DIM)
    at = lambda f, d: [(r.f, r.v) for r in R.as_of(f, d, {"k": "nk"}, F.col("d"), how, slice_rows=0, slice_bytes=0).collect()]
    assert at(facts, dim) == [(1, 7)]
    assert at(facts.limit(0), dim) == []
    assert at(facts, dim.limit(0)) == ([(1, None)] if how == "left" else [])


def test_a_hot_key_with_many_versions(spark):
    """10^5 facts and 10^4 versions of one key: no pairs, and no group with more than a small share of the facts."""
    n, m = 100_000, 10_000
    at = F.timestamp_seconds(F.col("id") * 7919 % n * 10)
    facts = spark.range(n).select(F.col("id").alias("f"), F.lit(1).alias("k"), at.alias("t"))
    start = F.timestamp_seconds(F.col("id") * 100 + 50)
    dim = spark.range(m).select(F.lit(1).alias("nk"), F.col("id").alias("v"), start.alias("start_date"), F.when(F.col("id") < m - 1, F.timestamp_seconds(F.col("id") * 100 + 150)).alias("end_date"))
    out = R.as_of(facts, dim, {"k": "nk"}, F.col("t"), slice_rows=1000, slice_bytes=0)
    starts = [v * 100 + 50 for v in range(m)]
    want = sum(f * (bisect.bisect_right(starts, f * 7919 % n * 10) - 1) for f in range(n) if f * 7919 % n * 10 >= 50)
    got = out.agg(F.count("*").alias("n"), F.sum(F.col("f") * F.col("v")).alias("s")).first()
    assert (got.n, got.s) == (n - 5, want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowexpression" in plan.lower() or "Window [" in plan
    cuts = R._cuts(facts.select(F.col("k").alias("_k0"), F.col("t").alias("_t")), ["_k0"], 1000).collect()
    assert len(cuts) == 1 and len(cuts[0]["_cuts"]) == R.SLICES - 1
    sizes = facts.crossJoin(F.broadcast(R._cuts(facts.select(F.col("k").alias("_k0"), F.col("t").alias("_t")), ["_k0"], 1000)))
    sizes = sizes.groupBy(F.size(F.filter("_cuts", lambda x: x <= F.col("t")))).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * n / R.SLICES
