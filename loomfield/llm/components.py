"""Connected components of a table of links, by alternating large and small stars.

Each round links every node's larger neighbours to the least node it knows, then its smaller ones;
paths halve, so a chain of n links takes about log n rounds. Every round is written in the shared
folder. A node's least neighbour is an aggregate that begins before the shuffle; where it is joined back,
the links of a hub (``HUB``) are spread over SALTS keys by their far end, so no task gets all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch

#: Paths halve in a round, so no table that can be stored needs as many.
ROUNDS = 64
#: A hub has more links than this and than one in HUBS of all, so there are at most 2 * HUBS of them.
HUB, HUBS, SALTS = 50_000, 1024, 64


def _both(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) from both ends (large), or from the greater one."""
    if large:
        return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def hubs_of(links: DataFrame, large: bool) -> list:
    """The nodes that are hubs in a written table of links; a bounded list."""
    every = links.count()
    if every <= HUB:
        return []
    counts = _both(links, large).groupBy("u").agg(F.count("*").alias("n"))
    return [r["u"] for r in counts.filter(F.col("n") > max(HUB, every / HUBS)).select("u").collect()]


def salted(both: DataFrame, least: DataFrame, hubs: list) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) and least nodes (u, m), each with a salt ``s`` to join on: SALTS of them for a hub, else 0 alone."""
    hub = F.col("u").isin(hubs)
    salt = F.when(hub, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)
    every_salt = F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return both.withColumn("s", salt), least.withColumn("s", F.explode(every_salt))


def _star(links: DataFrame, large: bool, hubs: list) -> DataFrame:
    """Links (u, v): each node's neighbours above it (large) or not above it (small) go to its least neighbour."""
    both = _both(links, large)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if hubs:
        dealt, copies = salted(both, least, hubs)
        joined = dealt.join(copies, ["u", "s"])
    else:
        joined = both.join(least, "u")
    moved = joined.filter(F.col("v") > F.col("u")).select("v", "m") if large else joined.select("v", "m").union(least.select("u", "m"))
    return moved.toDF("u", "v").filter("u != v").distinct()


def _round(now: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """A large and a small star; the links between are written where there are enough of them for a hub."""
    if now.count() <= HUB:  # a large star leaves no more links than it gets
        return _star(_star(now, True, []), False, [])
    between = scratch.write(_star(now, True, hubs_of(now, True)), f"{name}-large")
    return _star(between, False, hubs_of(between, False))


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v); root is the least node of its component."""
    now = scratch.write(links.select("u", "v").filter("u != v").distinct(), f"{name}-0")
    seen = None
    for k in range(1, ROUNDS + 1):
        now = scratch.write(_round(now, scratch, f"{name}-{k}"), f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
