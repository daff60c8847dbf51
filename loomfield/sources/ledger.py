"""Loads that take every file once.

The ledger is a table of files (path, size, modification time) by load. A load writes the files it is
going to take into the ledger first, then the rows, marked with the load's number, and then that it is
done. A load that was cut off is finished by the next one with the very files it had begun with; if its
rows are there already, their mark says so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.sources.files import Loaded, list_files, load_audit, load_csv
from loomfield.sources.store import ConcurrentWrite, Store

C = F.col
LEDGER = "load_ledger"
KINDS = "target string, number int, run string, state string, path string, length long, modified timestamp, at timestamp"


def _ledger(log: Store, table: str) -> DataFrame:
    rows = log.read(LEDGER) if log.exists(LEDGER) else log.spark.createDataFrame([], KINDS)
    return rows.filter(C("target") == table)


def _taken(log: Store, table: str) -> DataFrame:
    """The files of all finished loads, each as it was when it was last loaded."""
    rows = _ledger(log, table)
    done = rows.filter("state = 'DONE'").select("number").distinct()
    files = rows.filter("state = 'STARTED'").join(done, "number", "left_semi")
    latest = Window.partitionBy("path").orderBy(C("number").desc())
    return files.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").select("path", "length", "modified")


def pending(log: Store, path: str, table: str) -> DataFrame:
    """Files under a path that no finished load has as they are now: ``NEW``, or ``CHANGED`` since they were loaded."""
    known = _taken(log, table).select("path", C("length").alias("_l"), C("modified").alias("_m"))
    both = list_files(log.spark, path).join(known, "path", "left")
    same = (C("length") == C("_l")) & (C("modified") == C("_m"))
    found = both.filter(C("_l").isNull() | ~same).withColumn("state", F.when(C("_l").isNull(), "NEW").otherwise("CHANGED"))
    return found.select("path", "length", "modified", "state")


def _open(log: Store, table: str) -> int | None:
    """The number of a load that has begun and not ended."""
    rows = _ledger(log, table).groupBy("number").agg(F.count_if(C("state") == "DONE").alias("done")).filter("done = 0")
    found = rows.agg(F.min("number")).first()
    return found[0] if found else None


def _begin(log: Store, files: DataFrame, table: str) -> int:
    number = (_ledger(log, table).agg(F.max("number")).first()[0] or 0) + 1
    run = uuid.uuid4().hex
    rows = files.select(
        F.lit(table).alias("target"), F.lit(number).alias("number"), F.lit(run).alias("run"), F.lit("STARTED").alias("state"),
        "path", "length", "modified", F.current_timestamp().alias("at"),
    )
    log.append(LEDGER, rows, marks={table: number})
    if _ledger(log, table).filter((C("number") == number) & (C("run") == run)).isEmpty():
        raise ConcurrentWrite(f"load {number} of {table} was begun by another process")
    return number


def _finish(raw: Store, log: Store, table: str, number: int) -> Loaded:
    """Write the rows of a load that has begun, unless they are there, and say that it is done."""
    begun = _ledger(log, table).filter((C("number") == number) & (C("state") == "STARTED"))
    # The names of a load's files; Spark's reader lists them on the driver as well.
    loaded = load_csv(raw.spark, [r["path"] for r in begun.select("path").collect()], table)
    mark = {"load": number}
    raw.append(table, loaded.rows, marks=mark)
    raw.append(f"{table}_rejects", loaded.rejects.withColumn("_load", F.lit(number)), marks=mark)
    log.append("load_history", load_audit(loaded, table).withColumn("loaded_at", F.current_timestamp()), marks={f"history {table}": number})
    done = log.spark.createDataFrame([(table, number, None, "DONE", None, None, None)], KINDS.rpartition(",")[0])
    log.append(LEDGER, done.withColumn("at", F.current_timestamp()), marks={f"done {table}": number})
    return loaded


def load_new(raw: Store, log: Store, path: str, table: str, again: bool = False) -> DataFrame:
    """Load the files under a path that are new, into ``table`` and ``<table>_rejects`` of ``raw``.

    Returns the new and the changed files with what became of them: ``LOADED``, or ``CHANGED`` for a file
    that was loaded before and is another one now. Such files are told and left, unless ``again`` is set.
    """
    if (number := _open(log, table)) is not None:
        _finish(raw, log, table, number)
    seen = pending(log, path, table).persist()
    try:
        take = seen if again else seen.filter("state = 'NEW'")
        if not take.isEmpty():
            _finish(raw, log, table, _begin(log, take, table))
        state = F.when(F.lit(again) | (C("state") == "NEW"), "LOADED").otherwise(C("state"))
        report = seen.withColumn("state", state).collect()  # as long as the list of new files
    finally:
        seen.unpersist()
    return log.spark.createDataFrame(report, "path string, length long, modified timestamp, state string")
