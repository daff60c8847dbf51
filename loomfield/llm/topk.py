"""Exact top-k inner products by a three-phase uniform threshold.

The vectors are cut into ``PARTS`` column parts; a candidate's score is the sum of its parts' scores.
A cell is a block of queries and a block of candidates; it lists and cuts by the scores of single parts.

1. Every cell lists, for each query, the k best candidates of each part. Those are scored in full, and
   the k-th best of a query is a safe cutoff of its true k best.
2. The cutoff divided by the number of parts is the uniform threshold: a candidate that reaches the
   cutoff reaches the threshold in some part, whatever the signs. Thresholds are sent to the cells
   with the queries, and every cell collects the entries that reach them.
3. What is collected is scored exactly where it stands, and no more than k of a query leave a cell.

Scale: queries come in blocks of ``QUERY_BLOCK`` and candidates in blocks of ``ROW_BLOCK``, fewer of
them where vectors are long, both packed as matrices of the smallest integers that hold them; a pair
of blocks is a key of its own, so that no task gets more than one at a time and no key is hot. A
cell sends ``k`` rows a query and part at most, whatever the scores. Blocks meet in a sort-merge
join: packed files look small enough to broadcast, but a side has a copy for every block of the
other. Thresholds are joined by block number, so nothing that grows with the input is broadcast.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part,
neither as query nor as candidate. Vectors of another length than a query's are not its
candidates. Repeated vectors tie and the smaller id comes first; a null id takes no part. A query
with fewer than k candidates gets all of them. Query rows repeated in full are one query; under an
id with several vectors the best of all of these stand. Other columns are ignored; an empty table gives none.
Scores are sums of integers in 64-bit floats, exact below 2^53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch, sliced, table

K = 10
PARTS = 2
QUERY_BLOCK = 8192
ROW_BLOCK = 16384
#: Components of the vectors of a block.
VALUES = 1 << 20
QUERIES_AT_ONCE = 64
UNIT = 1024.0


def quantised(vector: Column) -> Column:
    """floor(1024 x) of every component, as long; null where the vector takes no part."""
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < F.lit(math.inf)) & ~F.isnan(x.cast("double")), F.lit(False)))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(UNIT))))


def blocks(rows: DataFrame, size: int, scratch: Scratch, name: str) -> DataFrame:
    """(block, width, ids, matrix as bytes, their type) of rows (id, v).

    Rows are dealt by their place, so that an id that many rows share does not fill a block.
    """
    count, values = rows.agg(F.count("*"), F.sum(F.size("v").cast("long"))).first()
    n = max(1, math.ceil(count / size), math.ceil((values or 0) / VALUES))
    dealt = rows.select("id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("b"))

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        m = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max)
        return pa.table({"block": t.column("b")[:1], "width": t.column("width")[:1], "ids": pa.array([ids.astype("i8")], pa.list_(pa.int64())), "m": pa.array([m.astype(kind).tobytes()], pa.binary()), "kind": [kind]})

    return scratch.write(dealt.groupBy("b", "width").applyInArrow(run, "block int, width int, ids array<long>, m binary, kind string"), name)


def cells(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for every pair of a query block and a candidate block of one width, each with a key (q, c) of its own."""
    last = lambda df: (df.agg(F.max("block")).first()[0] or 0)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    more = [x for x in queries.columns if x not in ("block", "width", "ids", "m", "kind")]
    q = queries.select("width", F.col("block").alias("q"), *[F.col(x).alias(f"q_{x}") for x in ("ids", "m", "kind")], *more, every(last(candidates)).alias("c"))
    c = candidates.select("width", "ids", "m", "kind", F.col("block").alias("c"), every(last(queries)).alias("q"))
    return c.join(q.hint("merge"), ["q", "c", "width"])


FOUND = "query_id long, vec_id long, score long"


def part_scores(r: dict, parts: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(first query, ids of candidates, scores by part, what is no candidate) of a cell, some queries at a time."""
    w, ids = r["width"], np.array(r["ids"], np.int64)
    q, m = (np.frombuffer(r[f"{k}m"], r[f"{k}kind"]).astype("<f8").reshape(-1, w) for k in ("q_", ""))
    q_ids = np.array(r["q_ids"], np.int64)
    cut = np.linspace(0, w, parts + 1).astype(int)
    for lo in range(0, len(q), QUERIES_AT_ONCE):
        some = q[lo : lo + QUERIES_AT_ONCE]
        each = [some[:, a:b] @ m[:, a:b].T for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield lo, ids, each, q_ids[lo : lo + QUERIES_AT_ONCE, None] == ids[None, :]


def best(q_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each row of scores, by score and then by id; -inf is none."""
    if score.shape[1] > k:
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        at_q, at_c = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
    else:
        at_q, at_c = np.nonzero(np.isfinite(score))
    order = np.lexsort((ids[at_c], -score[at_q, at_c], at_q))
    at_q, at_c = at_q[order], at_c[order]
    rank = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
    at_q, at_c = at_q[rank < k], at_c[rank < k]
    return pa.RecordBatch.from_pydict({"query_id": q_ids[at_q], "vec_id": ids[at_c], "score": score[at_q, at_c].astype(np.int64)})


def local_lists(grid: DataFrame, k: int, parts: int) -> DataFrame:
    """Phase 1: the k best of each cell by each part's scores, with their full scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            r = b.to_pylist()[0]
            q_ids = np.array(r["q_ids"], np.int64)
            for lo, ids, each, own in part_scores(r, parts):
                listed = np.zeros(own.shape, bool)
                n = min(k, len(ids))
                for s in each:
                    np.put_along_axis(listed, np.argpartition(np.where(own, np.inf, -s), n - 1, axis=1)[:, :n], True, axis=1)
                yield best(q_ids[lo : lo + len(own)], ids, np.where(listed & ~own, sum(each), -np.inf), k * parts)

    return grid.select("width", "q_ids", "q_m", "q_kind", "ids", "m", "kind").mapInArrow(run, FOUND)


def reaching(grid: DataFrame, k: int, parts: int) -> DataFrame:
    """Phases 2 and 3: entries whose score of some part reaches the query's threshold, scored in full; the k best of a cell leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            r = b.to_pylist()[0]
            q_ids = np.array(r["q_ids"], np.int64)
            cut = {x["query_id"]: x["cut"] for x in r["cuts"]}
            least = np.array([cut.get(int(x), -np.inf) for x in q_ids])
            for lo, ids, each, own in part_scores(r, parts):
                some = least[lo : lo + len(own), None]
                open_ = np.zeros(own.shape, bool)
                for s in each:
                    open_ |= s >= some
                yield best(q_ids[lo : lo + len(own)], ids, np.where(open_ & ~own, sum(each), -np.inf), k)

    return grid.select("width", "q_ids", "q_m", "q_kind", "ids", "m", "kind", "cuts").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query among all other rows."""
    scratch = Scratch(vectors.sparkSession, "topk")
    every = vectors.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector)).alias("v"), is_query.alias("is_query")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    queries = blocks(every.filter("is_query").select("id", "v").distinct(), QUERY_BLOCK, scratch, "queries")
    candidates = blocks(every.select("id", "v"), ROW_BLOCK, scratch, "candidates")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    # A pair of rows is in one cell, so that what is listed twice stands in two rows of the same id.
    listed = local_lists(cells(queries, candidates), k, parts)
    kth = listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("cutoff"))
    # Fewer than k: no threshold, all is collected. Under an id with several vectors the cutoff is of all of these together.
    cut = kth.filter(F.col("n") == k).select("query_id", (F.col("cutoff") / F.lit(float(parts))).alias("cut"))
    of_block = queries.select("block", "width", F.explode(F.array_distinct("ids")).alias("query_id"))
    cuts = of_block.join(cut, "query_id", "left").groupBy("block", "width").agg(F.collect_list(F.struct("query_id", F.coalesce("cut", F.lit(-1e300)).alias("cut"))).alias("cuts"))

    ranked = reaching(cells(queries.join(cuts, ["block", "width"]), candidates), k, parts).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector among all others."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
