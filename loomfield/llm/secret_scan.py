"""Secret scans over an incremental blob ledger. DataFrame operations only.

Every version of a text is a blob named by its SHA-256. The ledger is a Parquet table of the
(blob, rule, rule version) pairs already scanned, with their findings. A scan takes the distinct
blobs of the rows it is given, keeps the pairs that the ledger lacks, runs those rules over those
blobs, appends the result, and joins the findings of all pairs back to every row that has the blob.

Scale: texts move once, to make them distinct, after each task has dropped its own repeats, so that
a blob that a third of the rows share is one row per task. The ledger is partitioned by rule and
version, so a new rule version reads no text that it need not and an old one is skipped whole. The
join back moves only names and findings, and the engine splits the hot keys of such a join.

Defined results: a null text counts as empty; an empty text has no findings. Repeated rows each
give a row. Very long texts are scanned whole. Other columns are ignored; an empty table gives no
rows. Findings of a kind never overlap; findings of different kinds may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch, table
from loomfield.llm.spans import SPAN, count, found, joined


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and how long a part of the match must be to count."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    part: str = r"(?s)^.*$"


_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = Rule("assign", 1, _KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""")
# Runs shorter than the bound match nowhere, so the bounds of these two stand in the patterns.
ACCESS = Rule("access", 1, r"AKIA[A-Z0-9]{16,}")
HEX = Rule("hex", 1, r"[0-9a-f]{24,}")
PEM = Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
BASE = ["assign", "access", "hex"]
RULES = (ASSIGN, ACCESS, HEX, PEM)
LEDGER = f"blob string, spans array<{SPAN}>, kind string, version int"


def matches(text: Column, rule: Rule, k: int) -> Column:
    spans = found(text, rule.pattern, k)
    if rule.least:
        spans = F.filter(spans, lambda x: F.char_length(F.regexp_extract(x["t"], rule.part, 1)) >= rule.least)
    return spans


class BlobLedger:
    """The table of scanned pairs under ``path``, partitioned by kind and version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the pairs that the ledger lacks and append what was found, blobs without findings too."""
        body = F.coalesce(F.col(text), F.lit(""))
        blobs = docs.select(F.sha2(body, 256).alias("blob"), body.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        known = {(r["kind"], r["version"]) for r in self.read().select("kind", "version").distinct().collect()}
        fresh = [(k, r) for k, r in enumerate(rules) if (r.kind, r.version) not in known]
        old = [(k, r) for k, r in enumerate(rules) if (r.kind, r.version) in known]
        if old:
            seen = self.read().groupBy("blob").agg(F.collect_set(F.concat_ws("/", "kind", "version")).alias("seen"))
            blobs = blobs.join(seen, "blob", "left")
            need = [F.when(~F.coalesce(F.array_contains("seen", f"{r.kind}/{r.version}"), F.lit(False)), self._pair(k, r)) for k, r in old]
        else:
            need = []
        pairs = F.array_compact(F.array(*need, *[self._pair(k, r) for k, r in fresh]))
        out = blobs.select("blob", F.explode(pairs).alias("p")).select("blob", "p.spans", "p.kind", "p.version")
        out.write.mode("append").partitionBy("kind", "version").parquet(self.path)

    @staticmethod
    def _pair(k: int, r: Rule) -> Column:
        return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), matches(F.col("text"), r, k).alias("spans"))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """All spans of each blob that has any, of the given rules in their given versions."""
        wanted = F.concat_ws("/", "kind", "version").isin(*[f"{r.kind}/{r.version}" for r in rules])
        rows = self.read().filter(wanted & (F.size("spans") > 0))
        return rows.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def scanned(docs: DataFrame, ledger: BlobLedger, carry: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ``carry`` columns of every row with ``spans``: (place of the kind in ``rules``, start, end, text)."""
    ledger.scan(docs, text, rules)
    named = docs.select(*carry, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_blob"))
    found_in = ledger.findings(rules).withColumnRenamed("blob", "_blob")
    none = F.array().cast(f"array<{SPAN}>")
    return named.join(found_in, "_blob", "left").select(*carry, F.coalesce("spans", none).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned into a ledger that is empty at first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scanned(docs, BlobLedger(spark, Scratch(spark, "ledger").root), ["doc_id"])
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    kinds = [r.kind for r in RULES]
    return rows.select(
        "doc_id",
        *[count(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(joined(base, BASE, True), 256).alias("base_sha256"),
        joined(F.col("spans"), kinds, True).alias("spans"),
    )


def _sql(kind: str, k: int, pattern: str, keep: str) -> str:
    """Spans of a kind in DuckDB: pieces between matches and matches, with running lengths."""
    p = pattern.replace("'", "''")
    return f"""SELECT n, '{kind}' AS kind, {k} AS k, s + length(gap) AS s, s + length(gap) + length(m) AS e, m FROM (
      SELECT n, gap, m, coalesce(sum(length(gap) + length(m)) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (
        SELECT n, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM (
          SELECT n, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gaps FROM docs WHERE regexp_matches(text, '{p}')))) WHERE {keep}"""


_ASSIGN_SQL = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE_SQL = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""".replace("'", "''")
ORACLE = f"""WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_sql("assign", 0, _ASSIGN_SQL, f"length(regexp_extract(m, '{_VALUE_SQL}', 1)) >= 6")}
  UNION ALL {_sql("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
  UNION ALL {_sql("hex", 2, "[0-9a-f]+", "length(m) >= 24")}
  UNION ALL {_sql("pem", 3, PEM.pattern, "true")}),
per AS (SELECT n, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (n)"""
