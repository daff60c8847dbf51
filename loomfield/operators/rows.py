"""Row operators that the SQL dialects express by QUALIFY, MERGE and correlated UPDATE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import differs
from loomfield.session import checkpointed


def _keys(df: DataFrame, order: Sequence[Column], tie: Sequence[str]) -> list[Column]:
    return [*order, *[F.col(c).asc_nulls_last() for c in tie]]


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tie: Sequence[str] = ()) -> DataFrame:
    """One row per key, the first in ``order``; ``tie`` makes the order total. A rank filter, so ranks are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_keys(df, order, tie))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def flag_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tie: Sequence[str] = (), flag: str = "_is_duplicate") -> DataFrame:
    """All rows, flagged unless they are the one that ``keep_latest`` keeps."""
    w = Window.partitionBy(*keys).orderBy(*_keys(df, order, tie))
    return df.withColumn(flag, F.row_number().over(w) > 1)


def flag_all_copies(df: DataFrame, keys: Sequence[str], flag: str = "_is_duplicate") -> DataFrame:
    """All rows, flagged where their key has more than one, the survivor too."""
    return df.withColumn(flag, F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def flag_exists(df: DataFrame, parent: DataFrame, on: dict[str, str], flag: str) -> DataFrame:
    """Whether a parent with the key exists: a left join to the distinct keys, null keys have none."""
    other = list(on.values())
    keys = parent.select(*[F.col(c).alias(f"_p_{c}") for c in other]).dropna().distinct().withColumn("_hit", F.lit(True))
    cond = [F.col(a) == F.col(f"_p_{b}") for a, b in on.items()]
    joined = df.join(keys, cond, "left")
    return joined.withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_p_{c}" for c in other])


def allocate_keys(df: DataFrame, key: str, order: Sequence[str], start: int = 0) -> DataFrame:
    """A dense surrogate key from ``start`` + 1 in the order of ``order``, without a single-partition window.

    Rows are range-partitioned, sorted and written once: the bounds of ranges are sampled anew whenever
    such a plan runs, so counts and rows must come from one run. The partitions' counts, one number
    each, then give the offset of the next; the place in its partition is in the id of every row.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    rows = checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.select(F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place"), *df.columns)
    offsets, at = [], start
    for part, n in sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect()):
        offsets.append((part, at))
        at += n
    shift = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    keyed = rows.join(F.broadcast(shift), "_part", "left")
    return keyed.select((F.col("_before") + F.col("_place") + 1).alias(key), *df.columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], change: Sequence[str] | None = None, update: Sequence[str] | None = None) -> DataFrame:
    """``target`` with ``source`` merged in: unmatched rows are added, matched ones overwritten in ``update`` where ``change`` differs.

    ``source`` has one row per key and the columns of ``target``. One full join on the keys; columns
    outside ``update`` keep the target's value, so surrogate keys are stable and a re-run changes nothing.
    """
    rest = [c for c in target.columns if c not in keys]
    change, update = list(change if change is not None else rest), list(update if update is not None else rest)
    t = target.select(*keys, F.struct(*rest).alias("_t"), F.lit(True).alias("_in_t"))
    s = source.select(*keys, F.struct(*rest).alias("_s"), F.lit(True).alias("_in_s"))
    both = t.join(s, list(keys), "full")
    is_new = F.col("_in_t").isNull()
    changed = F.lit(False)
    for c in change:
        changed = changed | ~F.col(f"_t.{c}").eqNullSafe(F.col(f"_s.{c}"))
    take = is_new | (F.col("_in_s").isNotNull() & changed)
    cols = [F.when(take if c in update else is_new, F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}")).alias(c) for c in rest]
    return both.select(*keys, *cols).select(*target.columns)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes from one snapshot to the next: an update is a DELETE of the old row and an INSERT of the new, both ``_is_update``."""
    rest = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("_o"))
    b = new.select(*keys, F.struct(*rest).alias("_n"))
    both = a.join(b, list(keys), "full").filter(~F.col("_o").eqNullSafe(F.col("_n")))
    update = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    sides = F.array_compact(
        F.array(
            F.when(F.col("_o").isNotNull(), F.struct(F.col("_o").alias("r"), F.lit("DELETE").alias("a"))),
            F.when(F.col("_n").isNotNull(), F.struct(F.col("_n").alias("r"), F.lit("INSERT").alias("a"))),
        )
    )
    return both.select(*keys, update.alias("_is_update"), F.explode(sides).alias("x")).select(*keys, "x.r.*", F.col("x.a").alias("_action"), "_is_update")


def scd2_apply(dim: DataFrame, batch: DataFrame, key: str, tracked: Sequence[str], as_of: Column) -> DataFrame:
    """A version table brought up to ``batch``, which has one row per key: changed versions end, new and changed keys begin.

    ``dim``: key, other attributes, start_date, end_date, is_current. Intervals are half-open: a
    version ends on the day the next begins, so every day has one version and none is lost between.
    """
    attrs = [c for c in dim.columns if c not in ("start_date", "end_date", "is_current")]
    current = dim.filter("is_current").select(key, *[F.col(c).alias(f"_old_{c}") for c in tracked])
    known = batch.select(*attrs).join(current.withColumn("_has", F.lit(True)), key, "left")
    moved = F.lit(False)
    for c in tracked:
        moved = moved | differs(F.col(c), F.col(f"_old_{c}"))
    starts = known.filter(F.col("_has").isNull() | moved).select(*attrs)
    ends = starts.select(F.col(key)).withColumn("_ends", F.lit(True))
    kept = dim.join(ends, key, "left").withColumn("_close", F.coalesce("_ends", F.lit(False)) & F.col("is_current"))
    kept = kept.select(*attrs, "start_date", F.when(F.col("_close"), as_of).otherwise(F.col("end_date")).alias("end_date"), (F.col("is_current") & ~F.col("_close")).alias("is_current"))
    fresh = starts.select(*attrs, as_of.alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"))
    return kept.unionByName(fresh)


def as_of_join(fact: DataFrame, dim: DataFrame, key: dict[str, str], day: Column, how: str = "inner", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Each fact row with the version of its key that holds on ``day``: an equi-join whose interval test is part of the join.

    For keys with few versions, and for facts that are a stream: each fact meets all versions of its key.
    """
    cond = [F.col(a) == F.col(b) for a, b in key.items()]
    cond += [F.col(start) <= day, F.col(end).isNull() | (F.col(end) > day)]
    return fact.join(dim, cond, how)


#: Facts of one key that one task may sort, and bytes of facts of which even all are a task's work.
SLICE_ROWS, SLICE_BYTES = 1 << 20, 64 << 20
#: Slices of a hot key, and the share of all facts (one in so many) beyond which a key is hot: so there are at most as many hot keys.
SLICES = 256


def _all_known(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def _cuts(facts: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Points of time that cut the facts of each hot key into slices of about equal size; at most SLICES keys with SLICES - 1 points."""
    counts = facts.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    hot = counts.join(F.broadcast(total), F.col("_n") > F.greatest(F.lit(most), F.col("_all") / SLICES)).select(*keys)
    points = F.percentile_approx("_t", [k / SLICES for k in range(1, SLICES)], 10 * SLICES)
    return facts.join(F.broadcast(hot), list(keys), "left_semi").groupBy(*keys).agg(points.alias("_cuts"))


def as_of(
    fact: DataFrame, dim: DataFrame, key: dict[str, str], day: Column, how: str = "inner", start: str = "start_date", end: str = "end_date",
    slice_rows: int = SLICE_ROWS, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Each fact row with the version of its key that holds on ``day``, by a sweep: one sort of facts and versions, no pairs.

    Facts and versions stand in one order of key and time, and a fact takes the last version before it. The
    versions of a key don't overlap; empty ones hold on no day. ``how`` is inner or left; facts with a null
    key or day have no version. The columns are those of a join.

    A key with more facts than ``slice_rows`` and than one in SLICES of all is cut by quantiles of its facts'
    time, each slice a group of its own; a version stands in every slice that it reaches into, which adds at
    most a row a slice, since versions don't overlap. Facts of one key and one instant stay together. Facts of
    less than ``slice_bytes`` in all, by the plan's own bound, aren't counted first.
    """
    keys = [f"_k{i}" for i in range(len(key))]
    c = F.col
    facts = fact.select(*[c(a).alias(k) for k, a in zip(keys, key)], day.alias("_t"), F.struct(*fact.columns).alias("_f"))
    versions = dim.filter(c(end).isNull() | (c(end) > c(start))).select(
        *[c(b).alias(k) for k, b in zip(keys, key.values())], c(start).alias("_t"), c(end).alias("_end"), F.struct(*dim.columns).alias("_v")
    )
    needed = [*keys, "_t"]
    known, versions = facts.dropna(subset=needed), versions.dropna(subset=needed)
    if fact._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > slice_bytes:
        cuts = F.broadcast(_cuts(known.select(*needed), keys, slice_rows))
        before = lambda test: F.size(F.filter("_cuts", test))
        at = F.when(c("_cuts").isNull(), 0).otherwise(before(lambda x: x <= c("_t")))
        last = F.when(c("_cuts").isNull(), 0).when(c("_end").isNull(), F.size("_cuts")).otherwise(before(lambda x: x < c("_end")))
        known = known.join(cuts, keys, "left").withColumn("_s", at).drop("_cuts")
        versions = versions.join(cuts, keys, "left").withColumn("_s", F.explode(F.sequence(at, last))).drop("_cuts")
    else:
        known, versions = known.withColumn("_s", F.lit(0)), versions.withColumn("_s", F.lit(0))
    both = known.withColumn("_is_fact", F.lit(True)).unionByName(versions.withColumn("_is_fact", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_s").orderBy("_t", "_is_fact").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.select("_is_fact", "_t", "_f", F.last("_v", True).over(w).alias("_v")).filter("_is_fact")
    holds = c("_v").isNotNull() & (c("_v")[end].isNull() | (c("_v")[end] > c("_t")))
    if how == "inner":
        return swept.filter(holds).select("_f.*", "_v.*")
    none = facts.filter(~_all_known(needed)).select("_f", F.lit(None).cast(versions.schema["_v"].dataType).alias("_v"))
    return swept.select("_f", F.when(holds, c("_v")).alias("_v")).unionByName(none).select("_f.*", "_v.*")
