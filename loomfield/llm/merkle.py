"""Merkle manifest of a dataset: a hash tree for each source, one over the sources, and a proof for every row.

A row is a leaf, the SHA-256 of its cells. The leaves of a source stand in order of their ids; three
neighbours at a time become the hash of their digests until one is left, the source's subroot, and the
subroots become the root in the same way. A row's proof is what its digest has to be hashed with on
its way to the root.

Leaves are cut into aligned blocks of 3**5. A task walks the tree of a block in postorder: a node
returns its digest, and while the recursion unwinds the digests of a node's children are appended, as
siblings, to the leaves below the other children. The roots of blocks are the nodes of a next, smaller
traversal of the same kind, until a source is one block; what lies above a block then goes down to its
rows by a join on the block.

Scale: a block is all a task ever holds, so a source with a third of the rows is many tasks; positions
come from range partitions (``ranks``), a level's traversal has a 243rd of the rows of the one below,
and no join has a key with more than 243 rows of a side. Only 32-byte digests travel, no texts.

Defined results: a null cell has its own mark, so null and empty differ. Rows without an id come first in
their source; rows with one id stand in the order of their digests, and repeated rows are leaves of
their own. A null source is a source and comes first. Other columns are no part of a leaf. A single
source's subroot is the root; a proof without siblings is the hash of nothing. An empty table gives
no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch, table
from loomfield.llm.ranks import ranked

#: Children of a node, and levels of a block.
FAN, LEVELS = 3, 5
BLOCK = FAN**LEVELS
CELLS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: binary, after: binary>>"
NO_PATH = f"CAST(array() AS {PATH})"

C = F.col


def digest(*cells: Column) -> Column:
    """SHA-256, as hex text, of cells that are marked by their length, or as missing."""
    text = [c.cast("string") for c in cells]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*marked), 256)


def walk(digests: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest over a run of leaves, ``levels`` above them, and for each leaf its siblings to the left and right by level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in digests]

    def visit(lo: int, hi: int, level: int) -> str:
        if level == 0:
            return digests[lo]
        step = FAN ** (level - 1)
        children = [(x, min(x + step, hi)) for x in range(lo, hi, step)]
        found = [visit(a, b, level - 1) for a, b in children]
        for k, (a, b) in enumerate(children):
            beside = ("".join(found[:k]), "".join(found[k + 1 :]))
            for leaf in range(a, b):
                paths[leaf].append(beside)
        return sha256("".join(found).encode()).hexdigest()

    return visit(0, len(digests), levels), paths


def height(n: int) -> int:
    """Levels until one node is left of ``n``."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (``k``, ``at``, ``n``, ``digest`` and others) with their ``path`` inside their block and its ``top``."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        n = rows.column("n")[0].as_py()
        # A block of a longer run is raised to its full height, also where it is the short last one.
        top, paths = walk(rows.column("digest").to_pylist(), LEVELS if n > BLOCK else height(n))
        bare = [[{"before": bytes.fromhex(a), "after": bytes.fromhex(b)} for a, b in p] for p in paths]
        kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
        rows = rows.append_column("path", pa.array(bare, kind))
        return rows.append_column("top", pa.array([top] * len(bare), pa.string())).drop_columns("block")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    dealt = nodes.withColumn("block", F.expr(f"at div {BLOCK}"))
    return dealt.groupBy("k", "block").applyInArrow(run, f"{kinds}, path {PATH}, top string")


def _rooted(nodes: DataFrame, scratch: Scratch, name: str, over: bool) -> DataFrame:
    """The nodes with ``subroot``, ``root`` and the whole ``path``; with ``over`` a tree stands above the keys."""
    levels = [scratch.write(_blocks(nodes), f"{name}0")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        below = levels[-1].filter((C("n") > BLOCK) & (C("at") % BLOCK == 0))
        up = below.select("k", F.expr(f"at div {BLOCK}").alias("at"), F.ceil(C("n") / BLOCK).alias("n"), C("top").alias("digest"))
        levels.append(scratch.write(_blocks(up), f"{name}{len(levels)}"))
        most = -(-most // BLOCK)
    ends = [x.filter(f"n <= {BLOCK} AND at = 0").select("k", C("top").alias("digest")) for x in levels]
    tops = ends[0]
    for x in ends[1:]:
        tops = tops.union(x)
    if over:
        row = tops.select(F.lit("").alias("k"), C("k").alias("of"), "digest")
        above = _rooted(ranked(row, "k", ["of"], scratch, f"{name}tops"), scratch, f"{name}over", False)
        above = above.select(C("of").alias("k"), "path", C("digest").alias("subroot"), "root")
    else:
        above = tops.select("k", F.expr(NO_PATH).alias("path"), C("digest").alias("subroot"), C("digest").alias("root"))
    # Whole keys below a block meet what is above them here, longer ones a level further up.
    above = above.select("k", F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"), *above.columns[1:])
    upper = above
    for x in reversed(levels):
        u = upper.select("k", "block", "whole", C("path").alias("rest"), "subroot", "root")
        rows = x.withColumn("block", F.expr(f"at div {BLOCK}")).withColumn("whole", C("n") <= BLOCK)
        met = rows.join(u, ["k", "block", "whole"])
        done = met.select(*x.columns[:-2], F.concat("path", "rest").alias("path"), "subroot", "root")
        upper = above.unionByName(done.select("k", C("at").alias("block"), F.lit(False).alias("whole"), "path", "subroot", "root"))
    return done


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(_hex(x["before"]), acc, _hex(x["after"])), 256))


def proof(path: Column) -> Column:
    """The hash of all siblings, from the leaf's to the root's, each level from left to right."""
    joined = F.array_join(F.transform(path, lambda x: F.concat(_hex(x["before"]), _hex(x["after"]))), "")
    return F.sha2(joined, 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Each row's id, leaf, siblings (``path``), subroot and root; with ``tampered``, that text's leaf as ``now``."""
    scratch = Scratch(docs.sparkSession, "merkle")
    leaf = digest(*[C(c) for c in CELLS])
    now = digest(*[tampered if c == "text" and tampered is not None else C(c) for c in CELLS])
    key = F.coalesce(F.concat(F.lit("1"), C("source").cast("string")), F.lit("0"))
    leaves = scratch.write(docs.select(key.alias("k"), "doc_id", leaf.alias("digest"), now.alias("now")), "leaves")
    nodes = ranked(leaves, "k", ["doc_id", "digest"], scratch, "nodes")
    return _rooted(nodes, scratch, "level", True).withColumnRenamed("digest", "leaf")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether the proof holds after line breaks are deleted from some texts."""
    docs = table(spark, sf_dir, "documents")
    some = F.crc32(C("doc_id").cast("string")) % 2 == 0
    rows = manifest(docs, F.when(some, F.translate("text", "\n", "")).otherwise(C("text")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof(C("path")).alias("proof_sha256"), folded(C("now"), C("path")).alias("folded_root"))
    return rows.withColumn("verified", C("folded_root") == C("root"))


# Positions are found level by level; crc32 is the bitwise form of the public polynomial.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN (list_reduce(list_prepend(4294967295, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))) & 1) = 1
      THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents
), marked AS (
  SELECT doc_id, source,
    COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || COALESCE(strlen(source) || ':' || source, '-')
      || COALESCE(strlen(lang) || ':' || lang, '-') || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    COALESCE(strlen(text) || ':' || text, '-') AS body, COALESCE(strlen(changed) || ':' || changed, '-') AS changed
  FROM d
), leaves AS (
  SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || changed) AS now FROM marked
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
), tree AS (
  SELECT source, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max(n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, level, pos // 3
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), above AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max(n + 2) // 3 FROM above WHERE n > 1 GROUP BY level, pos // 3
), way AS (
  SELECT p.source, p.pos AS leaf_pos, t.level, string_agg(CASE WHEN s.pos < t.pos THEN s.digest ELSE '' END, '' ORDER BY s.pos) AS before,
    string_agg(CASE WHEN s.pos > t.pos THEN s.digest ELSE '' END, '' ORDER BY s.pos) AS after
  FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND t.pos = p.pos // (3 ** t.level)::BIGINT AND t.n > 1
  JOIN tree s ON s.source IS NOT DISTINCT FROM t.source AND s.level = t.level AND s.pos // 3 = t.pos // 3
  GROUP BY ALL
  UNION ALL
  SELECT p.source, p.pos, 1000 + t.level, string_agg(CASE WHEN s.pos < t.pos THEN s.digest ELSE '' END, '' ORDER BY s.pos),
    string_agg(CASE WHEN s.pos > t.pos THEN s.digest ELSE '' END, '' ORDER BY s.pos)
  FROM placed p JOIN subroots r ON r.source IS NOT DISTINCT FROM p.source JOIN above t ON t.pos = r.pos // (3 ** t.level)::BIGINT AND t.n > 1
  JOIN above s ON s.level = t.level AND s.pos // 3 = t.pos // 3
  GROUP BY p.source, p.pos, t.level, t.pos
), steps AS (
  SELECT source, leaf_pos, before, after, row_number() OVER (PARTITION BY source, leaf_pos ORDER BY level) AS step FROM way
), proofs AS (
  SELECT source, leaf_pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY ALL
), fold AS (
  SELECT source, pos, doc_id, now AS digest, 0 AS step FROM placed
  UNION ALL
  SELECT f.source, f.pos, f.doc_id, sha256(s.before || f.digest || s.after), f.step + 1
  FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.leaf_pos = f.pos AND s.step = f.step + 1
), last AS (
  SELECT source, pos, arg_max(digest, step) AS folded_root FROM fold GROUP BY ALL
)
SELECT p.doc_id, p.leaf, r.subroot, a.digest AS root, COALESCE(w.proof_sha256, sha256('')) AS proof_sha256, l.folded_root, l.folded_root = a.digest AS verified
FROM placed p JOIN subroots r ON r.source IS NOT DISTINCT FROM p.source JOIN above a ON a.n = 1
JOIN last l ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.pos
LEFT JOIN proofs w ON w.source IS NOT DISTINCT FROM p.source AND w.leaf_pos = p.pos
"""
