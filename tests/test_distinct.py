"""Distinct counts from bitmaps by day against a plain distinct count."""

from datetime import date

from pyspark.sql import functions as F

from loomfield.operators import distinct


def test_rolls_up_and_merges(spark):
    day = F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 60).cast("int"))
    people = F.when(F.col("id") % 17 == 0, None).otherwise((F.col("id") * 7919) % 90_000 - 20_000)
    rows = spark.range(20_000).select("id", day.alias("day"), (F.col("id") % 3).alias("g"), people.alias("who"))
    by = [F.month("day").alias("month"), "g"]
    want = {(r.month, r.g): r.n for r in rows.groupBy(*by).agg(F.countDistinct("who").alias("n")).collect()}
    got = lambda days: {(r.month, r.g): r.n for r in distinct.counts(days, by, "n").collect()}
    assert got(distinct.by_day(rows, "day", ["g"], "who")) == want
    # Two loads that share rows.
    parts = [distinct.by_day(rows.filter(f), "day", ["g"], "who") for f in ("id % 5 < 3", "id % 5 > 1")]
    assert got(distinct.merged(*parts)) == want


def test_nulls_and_nothing(spark):
    kind = "day date, g string, who long"
    rows = spark.createDataFrame([(date(2020, 1, 1), "a", None), (None, None, 1), (None, None, 1), (None, None, 40_000)], kind)
    days = distinct.by_day(rows, "day", ["g"], "who")
    assert {(r.g, r.n) for r in distinct.counts(days, ["g"], "n").collect()} == {("a", 0), (None, 2)}
    assert distinct.counts(distinct.by_day(rows.limit(0), "day", ["g"], "who"), ["g"], "n").collect() == []


def test_ids_far_apart_take_little(spark):
    import pickle

    rows = spark.range(300).select(F.lit(date(2020, 1, 1)).alias("day"), (F.col("id") % 2).alias("g"), (F.col("id") * 40_000).alias("who"))
    days = distinct.by_day(rows, "day", ["g"], "who")
    assert len(pickle.dumps([tuple(r) for r in distinct.merged(days, days).collect()])) < 300 * 200
    assert {(r.g, r.n) for r in distinct.counts(days, ["g"], "n").collect()} == {(0, 150), (1, 150)}
