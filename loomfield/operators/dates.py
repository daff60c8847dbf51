"""The calendar dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import date_key


def calendar(spark: SparkSession, first: str = "2015-01-01", last: str = "2030-12-31") -> DataFrame:
    """One row per day. Week days are 1 for Monday to 7; names are whole words; weeks are ISO weeks."""
    d = F.col("calendar_date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("calendar_date"))
    weekday = F.weekday(d) + 1
    return days.select(
        date_key(d).alias("date_key"), d, weekday.alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.day(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month_num"), F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter_num"), F.year(d).alias("year_num"), (weekday >= 6).alias("is_weekend"),
    )
