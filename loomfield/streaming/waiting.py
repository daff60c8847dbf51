"""Rows that wait for their parent.

A child row whose parent is not there yet is kept in keyed state until the parent comes, or until a limit
passes. Both are told: nothing is dropped in silence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keyed state with timers and lists needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Waiting(StatefulProcessor):
    """State of a key: whether its parent has come, and the rows that wait, each with its deadline."""

    def __init__(self, keys: Sequence[str], child: T.StructType, limit_ms: int, keep_ms: int) -> None:
        self.keys, self.child, self.limit_ms, self.keep_ms = list(keys), child, limit_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parent = handle.getValueState("parent", T.StructType([T.StructField("at", T.LongType())]))
        since = [T.StructField("since", T.LongType()), T.StructField("child", self.child)]
        self.rows = handle.getListState("rows", T.StructType(since))

    def _out(self, key: tuple, child: Row, state: str, waited: int) -> Row:
        # A struct comes as a dictionary from Arrow, and as a row from the state.
        named = Row(**(child if isinstance(child, dict) else dict(zip(self.child.names, child))))
        return Row(**dict(zip(self.keys, key)), child=named, state=state, waited=waited / 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came, known, new = None, self.parent.exists(), []
        for r in rows:
            child, at = r["_child"], r["_ms"]
            if child is None:
                came = at
            elif known or came is not None:
                yield self._out(key, child, "RESOLVED", 0)
            else:
                new.append((at, tuple(child.values()) if isinstance(child, dict) else tuple(child)))
        if came is not None:
            self.parent.update((came,))
            self.handle.registerTimer(came + self.keep_ms)
            for since, child in [*((r[0], r[1]) for r in self.rows.get()), *new]:
                yield self._out(key, child, "RESOLVED", max(0, came - since))
            self.rows.clear()
        elif new:
            self.rows.appendList(new)
            for since in {x[0] for x in new}:
                self.handle.registerTimer(since + self.limit_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, stay = expiredTimerInfo.getExpiryTimeInMs(), []
        for r in self.rows.get():
            if r[0] + self.limit_ms <= at:
                yield self._out(key, r[1], "EXPIRED", at - r[0])
            else:
                stay.append((r[0], r[1]))
        if stay:
            self.rows.put(stay)
        else:
            self.rows.clear()
        if self.parent.exists() and self.parent.get()[0] + self.keep_ms <= at:
            self.parent.clear()

    def close(self) -> None:
        pass


def held(children: DataFrame, parents: DataFrame, keys: Sequence[str], limit_seconds: float, keep_seconds: float | None = None) -> DataFrame:
    """A stream of ``children`` as soon as their parent is there: the key, the row as ``child``, ``state`` and ``waited`` seconds.

    ``parents`` is a stream of rows with the key. A child is RESOLVED in the batch in which both are there,
    whichever came first, EXPIRED once a batch comes that is ``limit_seconds`` later, and NO_KEY at once where
    a part of its key is null. Time is that of arrival, which is also the watermark, so nothing is too late.
    A parent is remembered for ``keep_seconds`` after it came, ten limits unless told otherwise; children
    that come later should find it in the table it is stored in.
    """
    spark = children.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    key_of = [F.col(c).alias(c) for c in keys]
    child = F.struct(*[F.col(c) for c in children.columns])
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    kind = children.schema
    come = parents.filter(~no_key).select(*key_of, F.lit(None).cast(kind).alias("_child"))
    rows = children.filter(~no_key).select(*key_of, child.alias("_child")).unionByName(come)
    rows = rows.withColumn("_at", F.current_timestamp()).withWatermark("_at", "0 seconds").withColumn("_ms", F.unix_millis("_at"))
    fields = [T.StructField(c, kind[c].dataType) for c in keys]
    out = T.StructType([*fields, T.StructField("child", kind), T.StructField("state", T.StringType()), T.StructField("waited", T.DoubleType())])
    limit = int(limit_seconds * 1000)
    keep = int((10 * limit_seconds if keep_seconds is None else keep_seconds) * 1000)
    found = rows.groupBy(*keys).transformWithState(
        statefulProcessor=_Waiting(keys, kind, limit, keep), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )
    alone = children.filter(no_key).select(*key_of, child.alias("child"), F.lit("NO_KEY").alias("state"), F.lit(0.0).alias("waited"))
    return found.unionByName(alone)
