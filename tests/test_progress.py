"""Progress of streams as a table, and the files that still wait for a stream."""

import time

from pyspark.sql import functions as F

from loomfield.sources.files import stream_csv
from loomfield.sources.store import Store
from loomfield.streaming import pipeline as P
from loomfield.streaming import progress, sinks

HEAD = "seller_id,zip,city,state\n"


def names(df):
    return sorted(r.path.rpartition("/")[2] for r in df.collect())


def until(test, seconds=30):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.2)
    return test()


def test_progress_and_pending_files(spark, tmp_path):
    src, cp, store = tmp_path / "in", str(tmp_path / "cp"), Store(spark, str(tmp_path / "store"))
    src.mkdir()
    (src / "1 a+b%.csv").write_text(HEAD + "s1,1,a,sp\ns2,1,a,sp\n")
    assert names(progress.pending_files(spark, str(src), cp)) == ["1 a+b%.csv"]
    log = progress.ProgressLog(store)
    spark.streams.addListener(log)
    run = lambda: sinks.append_once(stream_csv(spark, str(src), "sellers").rows, cp, store, "sellers")
    took = lambda: store.read("stream_progress").agg(F.sum("rows")).first()[0] if store.exists("stream_progress") else 0
    try:
        run()
        assert until(lambda: took() == 2)
        assert names(progress.pending_files(spark, str(src), cp)) == []
        (src / "2.csv").write_text(HEAD + "s3,1,a,sp\n")
        assert names(progress.pending_files(spark, str(src), cp)) == ["2.csv"]
        run()
        assert until(lambda: took() == 3)
    finally:
        spark.streams.removeListener(log)
    (row,) = progress.lags(store, F.current_timestamp() + F.expr("interval 1 hour")).collect()
    assert (row.last_batch, row.batches, row.rows) == (1, 2, 3)
    assert 3600 <= row.seconds_since < 3900
    assert names(progress.taken_files(spark, cp)) == ["1 a+b%.csv", "2.csv"]
    # Rows of another stream are told apart.
    other = str(tmp_path / "other")
    spark.streams.addListener(log)
    try:
        P.follow(stream_csv(spark, str(src), "sellers").rows, other, lambda batch, n: None)
        assert until(lambda: took() == 6)
    finally:
        spark.streams.removeListener(log)
    assert sorted((r.batches, r.rows) for r in progress.lags(store).collect()) == [(1, 3), (2, 3)]


def test_rows_that_cannot_be_written_stay(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    log = progress.ProgressLog(store)
    log._rows = [("s", "r", None, 0, "2020-01-01T00:00:00Z", 5, 10, 0, 0, None, "[]")]

    def broken(*args):
        raise OSError("no room")

    monkeypatch.setattr(Store, "append", broken)
    try:
        log.flush()
    except OSError:
        pass
    monkeypatch.undo()
    log.flush()
    log.flush()
    assert [(r.rows, str(r.at), r.watermark) for r in store.read("stream_progress").collect()] == [(5, "2020-01-01 00:00:00", None)]
