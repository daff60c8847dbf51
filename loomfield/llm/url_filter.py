"""URL filters as a sort-merge range join on reversed-host canonical keys. DataFrame operations only.

A host's labels, reversed and each followed by a dot, make a key of which the key of every domain
above it is a prefix; in byte order a rule therefore covers an interval of keys, and the intervals
of rules nest. A sweep over urls and rules in key order keeps the stack of rules whose interval is
open: each rule carries the rules it is nested in, and a url meets the last rule that began before
it. That rule and those it is nested in are the only ones that can cover the url; the ones whose
interval has closed, or whose path is no prefix of the url's, are left out, and the longest of the
others (host first, then path) decides.

Scale: urls are dealt by the first two labels of the reversed host, which a rule of two labels or
more shares with all urls it covers; rules of one label go to every part. There are as many parts as
shuffle partitions, and more where a part would exceed ``TARGET`` urls. Domains with more urls than
a part's share are counted first and spread over several parts, to which their rules are copied; no
more such domains can exist than parts. One shuffle moves the urls, and no task gets a whole hot
host. The rules may be a table of any size; those of one chain of nested hosts are held
together on the stack.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and the
default verdict. Of rules with the same host and path the one least by verdict counts once. Rules
with a null host or path are left out; no rules at all give every url the default verdict. Repeated
rows each give a row, an empty table none. Other columns are kept by ``filtered`` under their names
(columns named host, path, rule or verdict are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.common import table

TARGET = 200_000
DEFAULT = "allow"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII capitals lowered) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^[^?#]*", 0), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/]*", 0)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), F.regexp_extract(rest, r"(?s)^[^/]*(/.*)?$", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot: ``www.example.net`` becomes ``net.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def domain(key: Column) -> Column:
    return F.substring_index(key, ".", 2)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key and the rules of it and of all domains above it."""
    one = rules.dropna(subset=["host", "path"]).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    own = one.select(host_key(F.col("host")).alias("key"), F.struct(F.length("host").alias("host_length"), F.length("path").alias("path_length"), "path", F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    labels = F.split(F.expr("substr(key, 1, length(key) - 1)"), r"\.")
    above = own.select("key").distinct().select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit(".")))).alias("up"))
    named = own.select(F.col("key").alias("up"), F.struct(F.col("key").alias("key"), "r.*").alias("r"))
    return above.join(named, "up").groupBy("key").agg(F.collect_list("r").alias("open"))


def filtered(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, target: int = TARGET) -> DataFrame:
    """All columns of ``urls`` with host, path, rule and verdict."""
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(url))
    rows = urls.select(F.struct(*own).alias("row"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host"))).withColumn("domain", domain(F.col("key")))
    keyed = stacks(rules).withColumn("domain", domain(F.col("key")))

    total = urls.count()
    parts = max(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / target))
    share = max(1, total // parts)
    # Domains above a part's share: fewer than parts of them, so that their list has a bound.
    hot = rows.groupBy("domain").count().filter(F.col("count") > share).select("domain", F.ceil(F.col("count") / share).cast("int").alias("salts"))
    rows = rows.join(F.broadcast(hot), "domain", "left")
    rule_salts = keyed.select("domain").distinct().join(F.broadcast(hot), "domain", "left")
    salts = F.coalesce(F.col("salts"), F.lit(1))
    # Rows of a host spread by their place in the scan; equal urls need not meet.
    part = lambda salt: F.pmod(F.xxhash64("domain", salt), F.lit(parts))
    rows = rows.select("row", "host", "path", "key", part(F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts).cast("int")).alias("part"), F.lit(None).cast(keyed.schema["open"].dataType).alias("open"))
    labels = F.size(F.split("key", r"\.")) - 1
    wide = keyed.filter(labels == 1).select("key", "open", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    deep = keyed.filter(labels > 1).join(rule_salts, "domain").select("key", "open", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), salts - 1), part))).alias("part"))
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("row", "host", "path")]
    events = rows.unionByName(wide.unionByName(deep).select(*nothing, "key", "part", "open"))

    # The sweep: within a part by key, a rule before the urls that have its very key.
    sweep = Window.partitionBy("part").orderBy("key", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("stack", F.last("open", ignorenulls=True).over(sweep)).filter(F.col("row").isNotNull())
    ranked = met.withColumn("best", F.array_max(F.transform(F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]) & F.startswith(F.col("path"), r["path"])), lambda r: F.struct(r["host_length"], r["path_length"], r["rule"], r["verdict"]))))
    return ranked.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filtered(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_HOST = f"translate(regexp_extract({_REST}, '^[^/?#]*'), '{ASCII_UPPER}', '{ASCII_LOWER}')"
_PATH = f"regexp_extract(regexp_extract({_REST}, '^[^?#]*'), '^[^/]*(/(?s:.*))?$', 1)"
ORACLE = f"""WITH rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
parts AS (SELECT row_number() OVER () AS n, page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
best AS (SELECT n, arg_max(h || p, length(h) * 1000000 + length(p)) AS rule, arg_max(v, length(h) * 1000000 + length(p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM parts LEFT JOIN best USING (n)"""
