"""What streams have done and what still waits for them, as tables that can be queried."""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from loomfield.sources.files import list_files
from loomfield.sources.store import Store

C = F.col
ROWS = (
    "stream string, run string, name string, batch long, at timestamp, rows long, millis long, "
    "state_rows long, late_rows long, watermark timestamp, sources string"
)


class ProgressLog(StreamingQueryListener):
    """Appends a row for each batch of every stream of the session to the table ``stream_progress``.

    Rows are written when there are ``every`` of them, when a stream ends, and by ``flush``; a driver that is
    lost takes at most that many rows with it. A batch that is tried again has a row for each run.
    """

    def __init__(self, store: Store, table: str = "stream_progress", every: int = 100) -> None:
        self.store, self.table, self.every = store, table, every
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        sources = json.dumps([{"source": s.description, "rows": s.numInputRows, "end": s.endOffset, "latest": s.latestOffset} for s in p.sources])
        row = (str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, p.batchDuration, state, late, p.eventTime.get("watermark"), sources)
        with self._lock:
            self._rows.append(row)
            full = len(self._rows) >= self.every
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        """Write what has come in; what can't be written stays for the next time."""
        with self._lock:
            rows, self._rows = self._rows, []
        if not rows:
            return
        try:
            kinds = ROWS.replace("timestamp", "string")
            typed = self.store.spark.createDataFrame(rows, kinds).withColumns({c: C(c).cast("timestamp") for c in ("at", "watermark")})
            self.store.append(self.table, typed.coalesce(1))
        except Exception:
            with self._lock:
                self._rows = rows + self._rows
            raise


def lags(store: Store, now: Column | None = None, table: str = "stream_progress") -> DataFrame:
    """For each stream its last batch, the seconds since, and rows, batches and rows a second of all its batches that took rows."""
    w = Window.partitionBy("stream").orderBy(C("at").desc(), C("batch").desc())
    rows = store.read(table)
    last = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("stream", "name", C("batch").alias("last_batch"), "at", "state_rows", "watermark")
    took = rows.filter("rows > 0").groupBy("stream").agg(
        F.countDistinct("batch").alias("batches"), F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows"),
        F.round(F.try_divide(F.sum("rows") * 1000, F.sum("millis")), 3).alias("rows_a_second"),
    )
    since = (now if now is not None else F.current_timestamp()).cast("timestamp").cast("double") - C("at").cast("double")
    return last.join(took, "stream", "left").withColumn("seconds_since", since)


def _plain(path: Column) -> Column:
    """A path as all of Spark's ways to write one agree on it."""
    return F.regexp_replace(path, "^([a-z0-9]+):///", "$1:/")


def taken_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The files that a file stream has put into a batch, from its checkpoint: path and the first batch with it."""
    lines = spark.read.text(f"{checkpoint}/sources/*/*").filter(C("value").startswith("{"))
    entry = lines.select(F.from_json("value", "path string, batchId long").alias("x")).select("x.*")
    # The log writes paths as URLs do, but for the plus sign.
    path = _plain(F.url_decode(F.replace(C("path"), F.lit("+"), F.lit("%2B"))))
    return entry.groupBy(path.alias("path")).agg(F.min("batchId").alias("batch"))


def pending_files(spark: SparkSession, folder: str, checkpoint: str) -> DataFrame:
    """Files of a stream's folder that no batch has taken: path, length, modified. All of them before the stream has begun."""
    there = list_files(spark, folder).withColumn("path", _plain(C("path")))
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/sources")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return there
    return there.join(taken_files(spark, checkpoint), "path", "left_anti")
