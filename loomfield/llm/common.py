"""Helpers shared by the training-data operators: scratch tables, table readers, Arrow batches.

Nothing here touches a machine-local folder on a cluster: intermediate tables go to the folder that
``spark.checkpoint.dir`` names, which the driver and all executors share.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What a Python worker gets at once, whatever the length of the texts; a longer text comes alone.
BATCH_BYTES = 2 << 20
#: Tasks that write an intermediate table, for each core of the session.
TASKS = 4

_own: dict[str, str] = {}


def bounded(spark: SparkSession) -> None:
    """Arrow batches of the session hold ``BATCH_BYTES`` at most: rows alone, 10,000 of them, bound no memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where the setting is absent (tests, local runs)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="loomfield-"))


class Scratch:
    """Intermediate tables written as Parquet in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        bounded(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read back with the known schema (an empty result reads back too).

        Small shuffle partitions are taken together to ``TASKS`` for each core: a file costs far more than its rows.
        """
        tasks = TASKS * self.spark.sparkContext.defaultParallelism
        # Snappy's codec keeps direct buffers for each column of each file until a full collection; this one keeps none.
        df.coalesce(tasks).write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; with no name, everything."""
        jvm = self.spark.sparkContext._jvm
        for p in [self.path(n) for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released() -> None:
    """Give freed memory of this worker back: it lives on after its task, beside the workers of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that what a worker makes of one stays small; at the end memory is given back."""
    try:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                yield b.slice(lo, rows)
    finally:
        released()
