"""Order of all suffixes of a table of strings, by the distributed difference-cover algorithm.

Positions 1 and 2 modulo 3 are sampled. The triples of symbols there are named by their place in
sorted order; where names repeat, the names of each string make two shorter strings (positions 1
and positions 2) that are ordered by recursion. The remaining suffixes, at positions 0 modulo 3, are
merged in: a symbol and the rank of the suffix after it compare them with each other and with
positions 1, two symbols and the rank after them with positions 2.

Suffixes need to be told apart only as far as ``limit`` units of weight (a symbol has a weight), so
the recursion ends once every repeated name weighs that much or ends its string; suffixes that
agree so far share a rank.

Scale: sorts are range partitions; the only things that come to the driver are the row counts of
partitions. Repeated triples are one row before they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch

STRINGS = "sid long, v array<long>, c array<long>"


def cumulative(rows: DataFrame, keys: list[str], tag: str, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with n0 and n1: how many of weight ``tag`` 0 and 1 stand strictly before, in the order of ``keys``.

    ``tag`` is 0 or 1, or for a table of repeated rows the count ``n`` with tag 0.
    """
    weight = "n" if "n" in rows.columns else None
    cols = rows.columns
    # The partition is a column: a task that writes several partitions has one number for all of them.
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*cols, F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, start = np.zeros(2, np.int64), None, np.zeros(2, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(cols.index(x)).to_numpy(zero_copy_only=False) for x in keys], 1)
            t = b.column(cols.index(tag)).to_numpy(zero_copy_only=False)
            w = b.column(cols.index(weight)).to_numpy(zero_copy_only=False) if weight else np.ones(len(t), np.int64)
            each = np.stack([np.where(t == 0, w, 0), np.where(t == 1, w, 0)], 1)
            before = total + np.cumsum(each, 0) - each
            new = np.r_[last is None or bool((k[0] != last).any()), (k[1:] != k[:-1]).any(1)]
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            n = np.where((at >= 0)[:, None], before[at], start)
            total, last, start = total + each.sum(0), k[-1], n[-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n[:, 0]), pa.array(n[:, 1]), b.column(len(cols))], names=[*cols, "n0", "n1", "part"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = scratch.write(dealt.mapInArrow(run, f"{kinds}, n0 long, n1 long, part int"), name)
    size = F.col(weight) if weight else F.lit(1)
    sums = sorted(out.groupBy("part").agg(F.sum(F.when(F.col(tag) == 0, size).otherwise(0)), F.sum(F.when(F.col(tag) == 1, size).otherwise(0))).collect())
    offsets, a, b = [], 0, 0
    for part, x, y in sums:
        offsets.append((part, a, b))
        a, b = a + x, b + y
    if not offsets:
        return out.drop("part")
    shift = rows.sparkSession.createDataFrame(offsets, "part int, o0 long, o1 long")
    return out.join(F.broadcast(shift), "part").select(*cols, (F.col("n0") + F.col("o0")).alias("n0"), (F.col("n1") + F.col("o1")).alias("n1"))


def flat(lists: pa.Array) -> np.ndarray:
    """The values of a column of lists, end to end; null lists have none."""
    return lists.flatten().to_numpy(zero_copy_only=False)


def places(sid: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value of a column of lists: its row's sid, its place in the list, and how many are left from it on."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(sid.to_numpy(zero_copy_only=False), n), i, np.repeat(n, n) - i


def _arrays(rows: DataFrame, by: list[str], *cols: str) -> DataFrame:
    """The columns of ``rows`` (by, i, cols) as arrays in the order of i."""
    sorted_rows = F.array_sort(F.collect_list(F.struct("i", *cols)))
    got = rows.groupBy(*by).agg(sorted_rows.alias("x"))
    return got.select(*by, *[F.col(f"x.{c}").alias(c) for c in cols])


def suffix_order(strings: DataFrame, limit: int, scratch: Scratch, level: int = 0) -> DataFrame:
    """(sid, less): for each position of each string the number of suffixes of the table that are smaller."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, i, left = places(b.column(0), b.column(1))
            v, c = (np.append(flat(b.column(k)), [-1, -1]) for k in (1, 2))
            j = np.flatnonzero(i % 3 > 0)
            one, two = left[j] > 1, left[j] > 2
            cover = c[j] + np.where(one, c[j + 1], 0) + np.where(two, c[j + 2], 0)
            yield pa.RecordBatch.from_pydict({"sid": sid[j], "i": i[j], "t0": v[j], "t1": np.where(one, v[j + 1], -1), "t2": np.where(two, v[j + 2], -1), "cover": cover})

    triples = scratch.write(strings.select("sid", "v", "c").mapInArrow(cut, "sid long, i long, t0 long, t1 long, t2 long, cover long"), f"triples-{level}")
    counted = triples.groupBy("t0", "t1", "t2").agg(F.count("*").alias("n"), F.first("cover").alias("cover")).withColumn("tag", F.lit(0))
    names = cumulative(counted, ["t0", "t1", "t2"], "tag", scratch, f"names-{level}")
    named = triples.join(names.select("t0", "t1", "t2", F.col("n0").alias("name")), ["t0", "t1", "t2"]).select("sid", "i", "name", "cover")
    if names.filter((F.col("n") > 1) & (F.col("cover") < limit) & (F.col("t2") >= 0)).limit(1).count():
        shorter = _arrays(named.withColumn("m", F.col("i") % 3), ["sid", "m"], "name", "cover")
        shorter = scratch.write(shorter.select((F.col("sid") * 2 + F.col("m") - 1).alias("sid"), F.col("name").alias("v"), F.col("cover").alias("c")), f"strings-{level + 1}")
        deeper = suffix_order(shorter, limit, scratch, level + 1)
        halves = deeper.select(F.shiftright("sid", 1).alias("sid"), (F.col("sid") % 2).alias("m"), "less")
        ranks = halves.groupBy("sid").agg(F.max(F.when(F.col("m") == 0, F.col("less"))).alias("r1"), F.max(F.when(F.col("m") == 1, F.col("less"))).alias("r2"))
    else:
        halves = _arrays(named.withColumn("m", F.col("i") % 3), ["sid", "m"], "name")
        ranks = halves.groupBy("sid").agg(F.max(F.when(F.col("m") == 1, F.col("name"))).alias("r1"), F.max(F.when(F.col("m") == 2, F.col("name"))).alias("r2"))
    both = scratch.write(strings.select("sid", "v").join(ranks, "sid", "left"), f"ranked-{level}")

    def keys(second: int):
        """Rows to merge positions 0 with positions ``second``: symbols, then the rank of the sampled suffix after them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sid, i, left = places(b.column(0), b.column(1))
                v = np.append(flat(b.column(1)), -1)
                rank = np.full(len(i) + 3, -1, np.int64)
                for m in (1, 2):
                    rank[np.flatnonzero(i % 3 == m)] = flat(b.column(1 + m))
                j = np.flatnonzero((i % 3 == 0) | (i % 3 == second))
                after = np.where(left[j] > 1, v[j + 1], -1) if second == 2 else np.zeros(len(j), np.int64)
                then = np.where(left[j] > second, rank[j + second], -1)
                yield pa.RecordBatch.from_pydict({"sid": sid[j], "i": i[j], "k0": v[j], "k1": after, "k2": then, "tag": (i[j] % 3 > 0).astype(np.int64), "own": rank[j]})

        return both.mapInArrow(run, "sid long, i long, k0 long, k1 long, k2 long, tag long, own long")

    one = cumulative(keys(1), ["k0", "k1", "k2"], "tag", scratch, f"merge1-{level}")
    two = cumulative(keys(2), ["k0", "k1", "k2"], "tag", scratch, f"merge2-{level}")
    # A remaining suffix: those of its kind before it count once. A sampled one: its rank among the sampled.
    parts = one.select("sid", "i", F.when(F.col("tag") == 0, F.col("n0") + F.col("n1")).otherwise(F.col("own") + F.col("n0")).alias("less")).union(
        two.select("sid", "i", F.when(F.col("tag") == 0, F.col("n1")).otherwise(F.col("own") + F.col("n0")).alias("less"))
    )
    out = scratch.write(_arrays(parts.groupBy("sid", "i").agg(F.sum("less").alias("less")), ["sid"], "less"), f"order-{level}")
    scratch.drop(*(f"{x}-{level}" for x in ("triples", "names", "ranked", "merge1", "merge2")), *([f"strings-{level}"] if level else []))
    return out
