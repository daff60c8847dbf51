"""Exact distinct counts that are kept by day and roll up: sets of ids, a row for each id of a day and group.

A month or a quarter is counted from its days' sets without the raw rows, and a load of late rows is merged into
the days that it touches. Bitmaps would be smaller where most ids of a bucket come on most days, but a bitmap takes
4 KB for the few ids that a day and group of many buckets hold, and a sort of them is as many times larger than
what was shuffled. Null ids count nowhere, as in a distinct count; a group of null ids alone has count 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_day(rows: DataFrame, day: str, groups: Sequence[str], id: str) -> DataFrame:
    """A row for each day, group and id: ``day``, the groups, ``id``."""
    return rows.select(F.col(day), *[F.col(g) for g in groups], F.col(id).alias("id")).distinct()


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sets of two loads as one; a row that both hold counts once."""
    return old.unionByName(new).distinct()


def counts(days: DataFrame, by: Sequence[str | Column], name: str) -> DataFrame:
    """Distinct ids of coarser groups, as months."""
    one = days.groupBy(*by, "id").agg(F.lit(1).alias("_one"))
    outer = [c for c in one.columns if c not in ("id", "_one")]
    return one.groupBy(*outer).agg(F.count("id").alias(name))
