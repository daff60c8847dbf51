"""Dense positions of rows inside their groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch


def ranked(df: DataFrame, key: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows with ``at``, their place from 0 among the rows of their key, and ``n``, how many these are.

    ``key`` is never null. Rows are dealt by ranges of key and order, so a key with a third of all rows
    has many partitions, and are written once with their partition and place: range bounds are sampled
    anew whenever such a plan runs. One small row for each key and partition then says how many of the
    key's rows come before. Rows that are alike in key and order stand in any order.
    """
    by = [F.col(key), *[F.col(c).asc_nulls_first() for c in order]]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = scratch.write(placed.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    runs = rows.groupBy(key, part.alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    of_key = Window.partitionBy(key)
    before = F.sum("_rows").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = runs.select(
        key, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_key).alias("n")
    )
    joined = rows.withColumn("_part", part).join(shift, [key, "_part"])
    return joined.select(*df.columns, (F.col("_place") + F.col("_shift")).alias("at"), "n")
