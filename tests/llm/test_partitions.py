"""Intermediate tables whose tasks write several partitions each: order and repeats stay exact."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm import common
from loomfield.llm.common import Scratch
from loomfield.llm.repeats import with_spans
from loomfield.llm.suffix_order import cumulative


@pytest.fixture
def many_partitions(spark, monkeypatch):
    """More shuffle partitions than writing tasks."""
    monkeypatch.setattr(common, "TASKS", 1)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_ranks_over_many_partitions(spark, many_partitions):
    rows = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("k"), (F.col("id") % 2).alias("tag"))
    got = cumulative(rows, ["k"], "tag", Scratch(spark, "test"), "ranks").collect()
    plain = [(r.k, r.tag) for r in rows.collect()]
    want = {k: tuple(sum(x < k and t == tag for x, t in plain) for tag in (0, 1)) for k in range(101)}
    assert len(got) == 500 and {r.k: (r.n0, r.n1) for r in got} == want


def test_repeats_over_many_partitions(spark, many_partitions):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    pool = [word(n) for n in (60, 90, 130, 200, 260)]
    texts = [word(r.randint(0, 80)) + r.choice(pool) + word(r.randint(0, 9)) + r.choice(pool)[r.randint(0, 30) :] for _ in range(60)]
    length, seen = 64, {}
    starts = lambda t: ((s, t[s : s + length]) for s in range(len(t) - length + 1))
    for t in texts:
        for _, x in starts(t):
            seen[x] = seen.get(x, 0) + 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for row in with_spans(df, length).collect():
        mark = np.zeros(len(row.text), bool)
        for s, x in starts(row.text):
            if seen[x] > 1:
                mark[s : s + length] = True
        got = np.zeros(len(row.text), bool)
        for x in row.spans or ():
            got[x.a : x.b] = True
        assert (mark == got).all(), row.row.doc_id
