"""Training corpus pipeline: five stages over the documents, each calling one operator of the subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. Every stage works on all that its predecessor kept; all but the last keep
the columns of documents.

Defined results, beside those of the operators: a text that is null, empty or without a letter has no
language and goes in the first stage; a later stage that is given such rows keeps them. Documents with
null or shared ids and repeated rows pass through as rows of their own, except that of a group of near
duplicates one row stays, that of the least id and then of the least text. A document whose text is
wholly repeated stays with an empty text. Columns of any name are kept as they are. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import jaccard_join, language_id, packing, pii, repeats
from loomfield.llm.common import Scratch

WORDS, SIMILARITY = 5, (80, 100)
#: Bytes of a passage that may stand only once; passages of 50 words are longer than this.
PASSAGE = 200


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns named by their place, so that none has a name that an operator adds; and the names they have now."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from a bounded sample of their labels."""
    model = language_id.fit(docs, key=F.col("doc_id"))
    rows, names = _numbered(docs)
    kept = language_id.identify(rows, model, names["text"]).filter(~F.col("rejected"))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and every document that has none."""
    scratch, work = Scratch(spark, "copies"), Scratch(spark, "jaccard")
    groups = jaccard_join.near_duplicates(docs, WORDS, *SIMILARITY, scratch=work)
    # A row for each id, class and component; components can have the same least id, or none, so a root names them.
    of_id = scratch.write(groups.groupBy("doc_id", "cls", "component_id", "root").agg(F.count("*").alias("n")), "groups")
    work.drop()
    shared = scratch.write(of_id.groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), "shared")
    least = of_id.filter("cls IS NOT NULL").filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "cls", "root")
    ids = scratch.write(least.join(shared, "doc_id", "left_anti").filter("doc_id IS NOT NULL").select("doc_id"), "ids")
    few = ids.limit(jaccard_join.FEW + 1).count() <= jaccard_join.FEW
    # The same blanks as those the words are split at.
    worded = F.coalesce(F.col("text").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    rows = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select(*docs.columns).union(docs.filter(~worded))
    if shared.isEmpty():
        return rows
    # Where ids are shared or null the text tells: of a component the row with the least text stays.
    unsure = docs.filter(worded).join(shared, "doc_id", "left_semi").select(*docs.columns).union(docs.filter(worded & F.col("doc_id").isNull()))
    numbered, names = _numbered(unsure)
    named = jaccard_join.with_class(numbered, WORDS, names["text"])
    first = lambda row, by: F.min_by(row, by).alias("row")
    of_class = named.groupBy(F.col(names["doc_id"]).alias("id"), "cls").agg(
        first(F.struct(*[F.col(n).alias(c) for c, n in names.items()]), F.col(names["text"])), F.min(names["text"]).alias("least_text")
    )
    met = of_class.alias("c").join(least.alias("l"), F.col("c.id").eqNullSafe(F.col("l.doc_id")) & (F.col("c.cls") == F.col("l.cls")))
    kept = met.groupBy("l.root").agg(first(F.col("c.row"), F.col("c.least_text")))
    return rows.union(kept.select("row.*"))


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that stand more than once, cut at whole code points."""
    rows = repeats.remaining(repeats.with_spans(docs, PASSAGE), points=True)
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.decode("kept", "UTF-8"))
    return _recounted(rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that reveal it, masked."""
    return _recounted(pii.sanitised(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids."""
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("language_id", identified),
    ("jaccard_join", without_near_copies),
    ("suffix_dedup", without_passages),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Tokens, centroids and suffix orders are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
