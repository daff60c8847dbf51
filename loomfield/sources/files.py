"""Raw files: typed CSV ingestion with provenance, rejects and a load audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield import schemas
from loomfield.functions import row_hash
from loomfield.sources.store import Store

#: Cells that stand for null; fixed values.
NULLS = ("NULL", "null", "", "NA", "N/A")
OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "mode": "PERMISSIVE",
}


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with their sizes, read through the file system the path names."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


@dataclass
class Loaded:
    rows: DataFrame
    rejects: DataFrame


def _bare(c: str) -> Column:
    return F.when(F.trim(c).isin(*NULLS), None).otherwise(F.trim(c))


def _typed(c: str, kind: str) -> Column:
    return _bare(c) if kind == "string" else _bare(c).try_cast(kind)


def _marked(cells: DataFrame, table: str) -> tuple[DataFrame, dict[str, str]]:
    """The cells with their file and the names of the columns that a type or a length refuses."""
    kinds = {f.name: f.dataType.simpleString() for f in schemas.struct(schemas.RAW[table]).fields}
    wrong = F.array_compact(
        F.array(
            *[F.when(_bare(n).isNotNull() & _typed(n, k).isNull(), F.lit(n)) for n, k in kinds.items() if k != "string"],
            *[F.when(F.length(_bare(n)) > schemas.LENGTHS.get(n, 50), F.lit(n)) for n, k in kinds.items() if k == "string"],
        )
    )
    return cells.select("*", F.col("_metadata.file_name").alias("_source_file"), wrong.alias("_wrong")), kinds


def _split(marked: DataFrame, kinds: dict[str, str], loaded_at: Column) -> Loaded:
    typed = [_typed(n, k).alias(n) for n, k in kinds.items()]
    hashed = row_hash(*[_bare(n) for n in kinds]).alias("_row_hash")
    good = marked.filter(F.size("_wrong") == 0).select(*typed, loaded_at.cast("timestamp_ntz").alias("_loaded_at"), "_source_file", hashed)
    return Loaded(good, marked.filter(F.size("_wrong") > 0))


def _text_schema(table: str) -> str:
    return ", ".join(f"`{f.name}` string" for f in schemas.struct(schemas.RAW[table]).fields)


def load_csv(spark: SparkSession, path: str | list[str], table: str, loaded_at: Column | None = None) -> Loaded:
    """A raw table from CSV (plain or gzip): columns by position; rows that a type or a length refuses go to ``rejects``.

    A reject keeps the cells as text and names the columns at fault.
    """
    cells = spark.read.options(**OPTIONS).schema(_text_schema(table)).csv(path)
    return _split(*_marked(cells, table), loaded_at if loaded_at is not None else F.current_timestamp())


def load_audit(loaded: Loaded, table: str) -> DataFrame:
    """Rows loaded and refused per source file."""
    ok = loaded.rows.groupBy("_source_file").agg(F.count("*").alias("loaded"))
    bad = loaded.rejects.groupBy("_source_file").agg(F.count("*").alias("rejected"))
    both = ok.join(bad, "_source_file", "full")
    zero = F.lit(0).cast("long")
    return both.select(F.lit(table).alias("target"), "_source_file", F.coalesce("loaded", zero).alias("loaded"), F.coalesce("rejected", zero).alias("rejected"))


def stream_csv(spark: SparkSession, path: str, table: str) -> Loaded:
    """The same as append-only streams of new files: a stream of rows, and one of rejects."""
    cells = spark.readStream.options(**OPTIONS).schema(_text_schema(table)).csv(path)
    return _split(*_marked(cells, table), F.current_timestamp())


def record_load(store: Store, loaded: Loaded, table: str) -> DataFrame:
    """Append the load's counts by file, with the time, to the table ``load_history``."""
    return store.append("load_history", load_audit(loaded, table).withColumn("loaded_at", F.current_timestamp()))


def load_history(store: Store, hours: float = 1) -> DataFrame:
    """Loads of the last hours, the latest first."""
    since = F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600))
    return store.read("load_history").filter(F.col("loaded_at") >= since).orderBy(F.col("loaded_at").desc(), "_source_file")
