"""Streams: a replayed batch counts once, a file that comes twice too, and a line waits for its order."""

import shutil
import time

import pytest
from pyspark.sql import functions as F

from loomfield.sources.files import stream_csv
from loomfield.sources.store import Store
from loomfield.streaming import pipeline as P
from loomfield.streaming import sinks, waiting

HEAD = "seller_id,zip,city,state\n"


def test_a_batch_that_is_replayed_counts_once(spark, tmp_path, monkeypatch):
    src, store, cp = tmp_path / "in", Store(spark, str(tmp_path / "store")), str(tmp_path / "cp")
    src.mkdir()
    rows = lambda: stream_csv(spark, str(src), "sellers").rows
    append = Store.append

    def broken(self, *args):
        append(self, *args)
        raise RuntimeError("after the write, before the checkpoint")

    (src / "1.csv").write_text(HEAD + "s1,1,a,sp\ns2,1,a,sp\n")
    monkeypatch.setattr(Store, "append", broken)
    with pytest.raises(Exception, match="before the checkpoint"):
        sinks.append_once(rows(), cp, store, "sellers")
    assert store.read("sellers").count() == 2
    monkeypatch.undo()
    sinks.append_once(rows(), cp, store, "sellers")
    assert store.read("sellers").count() == 2
    (src / "2.csv").write_text(HEAD + "s3,1,a,sp\n")
    sinks.append_once(rows(), cp, store, "sellers")
    assert sorted(r.seller_id for r in store.read("sellers").collect()) == ["s1", "s2", "s3"]
    # Another checkpoint is another stream, which takes everything.
    sinks.append_once(rows(), str(tmp_path / "other"), store, "sellers")
    assert store.read("sellers").count() == 6


def test_a_merge_that_is_replayed_counts_once(spark, tmp_path, monkeypatch):
    src, store, by = tmp_path / "in", Store(spark, str(tmp_path / "store")), F.col("state")
    src.mkdir()
    store.write("counts", spark.createDataFrame([("sp", 1), ("rj", 1), ("mg", 1)], "state string, n long"), by)
    before = {x["partition"]: x["path"] for x in store._folders("counts", 0)}
    add = lambda old, batch: old.union(batch.groupBy("state").count()).groupBy("state").agg(F.sum("n").alias("n"))
    rows = lambda: stream_csv(spark, str(src), "sellers").rows
    replace = Store.replace

    def broken(self, *args):
        replace(self, *args)
        raise RuntimeError("after the write")

    (src / "1.csv").write_text(HEAD + "s1,1,a,sp\ns2,1,a,sp\ns3,1,a,rj\n")
    monkeypatch.setattr(Store, "replace", broken)
    with pytest.raises(Exception, match="after the write"):
        sinks.merge_once(rows(), str(tmp_path / "cp"), store, "counts", add, by)
    monkeypatch.undo()
    sinks.merge_once(rows(), str(tmp_path / "cp"), store, "counts", add, by)
    assert {r.state: r.n for r in store.read("counts").collect()} == {"sp": 3, "rj": 2, "mg": 1}
    after = {x["partition"]: x["path"] for x in store._folders("counts", store.versions("counts")[-1])}
    assert after["mg"] == before["mg"] and after["sp"] != before["sp"]


def test_a_file_that_comes_twice_gives_its_rows_once(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    src.mkdir()
    (src / "1.csv").write_text(HEAD + "s1,1,a,sp\ns1,1,a,sp\ns2,1,a,sp\n")

    def run():
        rows = stream_csv(spark, str(src), "sellers").rows
        sinks.append_once(sinks.unrepeated(rows, ["seller_id"]), str(tmp_path / "cp"), store, "sellers")

    run()
    shutil.copy(src / "1.csv", src / "again.csv")
    (src / "2.csv").write_text(HEAD + "s2,1,a,sp\ns3,1,a,sp\n")
    run()  # started anew from its checkpoint
    assert sorted(r.seller_id for r in store.read("sellers").collect()) == ["s1", "s2", "s3"]


def test_lines_wait_for_their_order(spark, tmp_path):
    lines, orders, store = tmp_path / "lines", tmp_path / "orders", Store(spark, str(tmp_path / "store"))
    lines.mkdir(), orders.mkdir()

    def run(limit):
        children = spark.readStream.schema("order_id string, item int").json(str(lines))
        parents = spark.readStream.schema("order_id string, status string").json(str(orders))
        P.follow(waiting.held(children, parents, ["order_id"], limit, keep_seconds=3600), str(tmp_path / "cp"), lambda b, n: store.append("out", b))

    def out():
        return sorted((r.order_id or "", r.child.item, r.state) for r in store.read("out").collect()) if store.exists("out") else []

    put = lambda to, name, *rows: (to / name).write_text("\n".join(rows))
    put(lines, "1", '{"order_id": "o1", "item": 1}', '{"order_id": "o1", "item": 2}', '{"order_id": "o2", "item": 1}', '{"item": 9}', '{"order_id": "o3", "item": 1}')
    put(orders, "1", '{"order_id": "o3", "status": "x"}')
    run(3600)
    assert out() == [("", 9, "NO_KEY"), ("o3", 1, "RESOLVED")]
    # The order comes in a later batch, after a restart, and a line after its order.
    put(orders, "2", '{"order_id": "o1", "status": "x"}', '{"order_id": "o1", "status": "y"}')
    put(lines, "2", '{"order_id": "o3", "item": 2}')
    run(3600)
    assert out() == [("", 9, "NO_KEY"), ("o1", 1, "RESOLVED"), ("o1", 2, "RESOLVED"), ("o3", 1, "RESOLVED"), ("o3", 2, "RESOLVED")]


def test_lines_that_wait_too_long_are_told(spark, tmp_path):
    lines, orders, store = tmp_path / "lines", tmp_path / "orders", Store(spark, str(tmp_path / "store"))
    lines.mkdir(), orders.mkdir()

    def run():
        children = spark.readStream.schema("order_id string, item int").json(str(lines))
        parents = spark.readStream.schema("order_id string").json(str(orders))
        P.follow(waiting.held(children, parents, ["order_id"], 2.0), str(tmp_path / "cp"), lambda b, n: store.append("out", b))

    (orders / "1").write_text('{"order_id": "o7"}')
    (lines / "1").write_text('{"order_id": "o1", "item": 1}\n{"order_id": "o1", "item": 2}')
    run()
    time.sleep(2.5)
    (lines / "2").write_text('{"order_id": "o2", "item": 1}')
    run()
    rows = store.read("out").filter("state = 'EXPIRED' AND order_id = 'o1'").collect()
    assert sorted(r.child.item for r in rows) == [1, 2] and all(r.waited >= 2 for r in rows)
    (orders / "2").write_text('{"order_id": "o1"}')
    run()
    assert store.read("out").filter("state = 'RESOLVED'").count() == 0
