"""Streams that count every row once: sinks that know their batches, and sources that drop what comes again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomfield.sources.store import Store
from loomfield.streaming.pipeline import follow


def batch_mark(batch: DataFrame, number: int) -> dict[str, int]:
    """A micro-batch's mark: the identity that the stream's checkpoint gives it, and the batch's number."""
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return {f"stream {stream}": number}


def append_once(stream: DataFrame, checkpoint: str, store: Store, table: str, partition: Column | None = None, every: str | None = None) -> StreamingQuery:
    """Append a stream to a table, each batch once, however often it is tried.

    The batch's number is committed with its rows. A crash after that and before the checkpoint moves on
    replays the batch; the table then has its mark already and takes nothing.
    """
    return follow(stream, checkpoint, lambda batch, n: store.append(table, batch, partition, batch_mark(batch, n)), every)


def merge_once(stream: DataFrame, checkpoint: str, store: Store, table: str, merge: Callable[[DataFrame, DataFrame], DataFrame], partition: Column, every: str | None = None) -> StreamingQuery:
    """Merge a stream into a partitioned table, each batch once; ``merge`` makes the new rows of the partitions a batch touches."""

    def step(batch: DataFrame, n: int) -> None:
        values = sorted(r["v"] for r in batch.select(partition.cast("string").alias("v")).distinct().collect())
        store.replace(table, merge(store.partitions(table, values), batch), partition, values, batch_mark(batch, n))

    return follow(stream, checkpoint, step, every)


def unrepeated(stream: DataFrame, keys: Sequence[str], time: str = "_loaded_at", within: str = "1 day") -> DataFrame:
    """A stream without rows whose keys came before, in the same batch or in one up to ``within`` earlier.

    State is one key for each row of that time, and goes as the watermark passes. Rows with a null in a key
    are told apart like any other value, so of these too the first stays.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within)
    return timed.dropDuplicatesWithinWatermark(list(keys))
