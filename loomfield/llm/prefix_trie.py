"""Prefix trie of conversations: which openings they share, and how many words sharing spares.

A conversation is a sequence of turns, a turn known by a digest of its role and text. Conversations are
dealt by the digest of their first turn; a task builds a trie with pointers of one such subtrie and walks
it in postorder, without recursion. A subtrie that is too large for a task, or too large a share of all
turns, is dealt again by its next turn, and so on: the longest prefix that all its conversations share is
found first, from the least and the greatest of its sequences, so a long shared opening costs one round,
not one a turn. Totals of what was dealt on come back to the nodes above, round by round.

Scale: equal conversations are one member with a count before any trie is built, so copies are counted
map-side. What a task holds is ``TURNS`` turns at most, or a ``SHARE`` of all. Texts are read once and
not shuffled: a turn is 20 bytes after that. A conversation's turns stand in one row (16 bytes and a
count each). The hash over the ids of equal conversations is one stream by definition: ids are joined in
blocks of ``IDS`` in the shuffle, and the one task that has a hash to make reads blocks, one at a time.

Defined results: a null role or text is empty, a null turn comes first, turns with one number are in the
order of their digests. Repeated rows are turns of their own. Rows without conv_id are left out. With no
conversation there is no root and no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch, bounded, table

#: Turns of a subtrie that a task takes, and the part of all turns beyond which it is dealt on all the same.
TURNS, SHARE = 1 << 17, 1 / 1000
#: No subtrie of fewer turns is dealt on.
FEW_TURNS = 256
#: Ids of conversations that are joined to one block at most.
IDS = 1 << 8
#: Oversized groups that are broadcast at most, by count; more are joined by a shuffle.
FEW_GROUPS = 10_000
NO_IDS = sha256(b"").hexdigest()
TURN = "struct<k: binary, w: int>"
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

C = F.col


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` in order: a digest and a number of words each."""
    role, text = (F.coalesce(C(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", F.struct("turn", key.alias("k"), words.alias("w")).alias("t"))
    # Arrays of structs sort by turn, nulls first, and then by digest.
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["k"].alias("k"), t["w"].alias("w"))).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first h turns taken from the first of its group of ids; h by a checksum of its id."""
    donor = convs.filter(C("conv_id") % group == 0).select(C("conv_id").alias("_donor"), F.slice("turns", 1, most - 1).alias("_first"))
    h = (F.crc32(C("conv_id").cast("string").cast("binary")) % most).cast("int")
    met = convs.withColumn("_donor", C("conv_id") - C("conv_id") % group).join(donor, "_donor", "left")
    head = F.when(C("_first").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_first", F.lit(1), h))
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return met.select("conv_id", F.concat(head, tail).alias("turns"))


def _hashes(members: DataFrame) -> DataFrame:
    """For each sequence ``s`` the hash of the ids that have it, ascending."""
    block = F.expr(f"conv_id div {IDS}") - F.when((C("conv_id") < 0) & (C("conv_id") % IDS != 0), 1).otherwise(0)
    dealt = members.select("s", "conv_id", block.alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = dealt.groupBy("s", "block").agg(joined.alias("ids")).repartition("s").sortWithinPartitions("s", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hashed = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s == at:
                    hashed.update(b"," + ids.encode())
                    continue
                if hashed:
                    done.append((at, hashed.hexdigest()))
                at, hashed = s, sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"s": pa.array([x[0] for x in done], pa.binary()), "ends": pa.array([x[1] for x in done], pa.string())})
        if hashed:
            yield pa.RecordBatch.from_pydict({"s": pa.array([at], pa.binary()), "ends": [hashed.hexdigest()]})

    return blocks.select("s", "ids").mapInArrow(run, "s binary, ends string")


def trie_rows(members: list[dict], base: int, parent: int) -> list[tuple]:
    """The nodes of a subtrie below depth ``base``: members are distinct sequences with their counts and least ids.

    Nodes are entries of flat lists that point to one another by number; each has a dictionary from turn
    to child. A child's number is greater than its parent's, so numbers in falling order are a postorder.
    """
    children: list[dict[bytes, int]] = [{}]
    above, depth, words, ends = [0], [base], [0], [NO_IDS]
    count, least = [0], [parent]
    for m in members:
        at = 0
        for t in m["turns"][base:]:
            child = children[at].get(t["k"])
            if child is None:
                child = children[at][t["k"]] = len(children)
                children.append({})
                above.append(at)
                depth.append(depth[at] + 1)
                words.append(t["w"])
                ends.append(NO_IDS)
                count.append(0)
                least.append(m["least"])
            at = child
            count[at] += m["n"]
            least[at] = min(least[at], m["least"])
        ends[at] = m["ends"]
    leaves, saved = [0] * len(children), [0] * len(children)
    for at in range(len(children) - 1, 0, -1):
        leaves[at] = leaves[at] or 1
        saved[at] += (count[at] - 1) * words[at]
        leaves[above[at]] += leaves[at]
        saved[above[at]] += saved[at]
    return [(least[i], depth[i], least[above[i]], count[i], len(children[i]), leaves[i], saved[i], ends[i]) for i in range(1, len(children))]


def _small(members: DataFrame) -> DataFrame:
    """Nodes of subtries that a task holds, with the group they belong to."""
    names = [x.split()[0] for x in NODE.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        up, base, parent = (rows.column(c)[0].as_py() for c in ("up", "base", "parent"))
        found = trie_rows(rows.select(["turns", "n", "least", "ends"]).to_pylist(), base, parent)
        kinds = [pa.string() if n == "ends_sha256" else pa.int32() if n == "depth" else pa.int64() for n in names]
        columns = {n: pa.array(list(c), k) for n, k, c in zip(names, kinds, zip(*found))}
        return pa.table({"up": pa.array([up] * len(found), pa.binary()), "base": pa.array([base] * len(found), pa.int32())} | columns)

    return members.groupBy("g").applyInArrow(run, f"up binary, base int, {NODE}")


def _chain(big: DataFrame) -> DataFrame:
    """The nodes of the one path that all members of an oversized subtrie share.

    ``big`` has, beside its group, the totals of what hangs below the path: children, leaves, saved words.
    """
    nodes = big.select("*", F.posexplode("path").alias("pos", "t")).drop("path")
    # The turns from this one to the end of the path.
    rest = F.sum("t.w").over(Window.partitionBy("g").orderBy(C("pos").desc()))
    first, last = C("pos") == 0, C("base") + C("pos") + 1 == C("shared")
    return nodes.select(
        "up", "base", C("least").alias("conv_id"), (C("base") + C("pos") + 1).alias("depth"),
        F.when(first, C("parent")).otherwise(C("least")).alias("parent_conv_id"), "n_convs",
        F.when(last, C("below")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.greatest(C("leaves"), F.lit(1)).alias("n_leaves"),
        (C("saved") + (C("n_convs") - 1) * rest).alias("saved_tokens"), F.when(last, C("ends")).otherwise(F.lit(NO_IDS)).alias("ends_sha256"),
    )  # fmt: skip


def _next_key(g: Column, turns: Column, depth: Column) -> Column:
    """Names the subtrie of a group that goes on with the turn after ``depth``."""
    return F.unhex(F.md5(F.concat(g, F.element_at(turns, depth + 1)["k"])))


def _shared(rows: DataFrame) -> DataFrame:
    """For each oversized group its totals and the path that all its members share, as their least and greatest sequence do."""
    ends = rows.groupBy("g").agg(
        F.any_value("up").alias("up"), F.any_value("base").alias("base"), F.any_value("parent").alias("parent"), F.sum("n").alias("n_convs"),
        F.min("least").alias("least"), F.min("turns").alias("a"), F.max("turns").alias("b"),
    )  # fmt: skip
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: x["k"].eqNullSafe(y["k"])), F.lit(False)).cast("int")
    ends = ends.withColumn("shared", F.when(differs > 0, differs - 1).otherwise(F.least(F.size("a"), F.size("b"))))
    return ends.withColumn("path", F.slice("a", C("base") + 1, C("shared") - C("base"))).drop("a", "b")


def trie(convs: DataFrame, turns_of_a_task: int = TURNS, share: float = SHARE, few: int = FEW_TURNS) -> DataFrame:
    """The nodes of all conversations' sequences (``conv_id``, ``turns``)."""
    spark = convs.sparkSession
    bounded(spark)
    scratch = Scratch(spark, "trie")
    digest = F.unhex(F.md5(F.array_join(F.transform("turns", lambda t: F.hex(t["k"])), "")))
    all_members = scratch.write(convs.select("conv_id", digest.alias("s"), "turns"), "members")
    one = all_members.groupBy("s").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.any_value("turns").alias("turns"))
    classes = scratch.write(one.join(_hashes(all_members), "s"), "classes")
    n, least, turns = classes.agg(F.sum("n"), F.min("least"), F.sum(F.size("turns"))).first()
    if not n:
        return spark.createDataFrame([], NODE.replace("depth int", "depth long"))
    room = min(turns_of_a_task, max(few, int(turns * share)))
    root = classes.filter(F.size("turns") == 0).select("ends").first()

    start = F.unhex(F.md5(F.lit("")))
    members = classes.filter(F.size("turns") > 0).select(
        "n", "least", "turns", "ends", start.alias("up"), F.lit(0).alias("base"), F.lit(least).cast("long").alias("parent"),
        _next_key(start, C("turns"), F.lit(0)).alias("g"),
    )  # fmt: skip
    small, big = [], []
    while True:
        k = len(small)
        sizes = members.groupBy("g").agg(F.sum(F.size("turns") - C("base")).alias("size"))
        over = scratch.write(sizes.filter(C("size") > room).select("g"), f"over{k}")
        n_over = over.count()
        few_groups = (lambda df: F.broadcast(df)) if n_over <= FEW_GROUPS else (lambda df: df)
        rest = members.join(few_groups(over), "g", "left_anti") if n_over else members
        small.append(scratch.write(_small(rest), f"small{k}"))
        if not n_over:
            break
        rows = scratch.write(members.join(few_groups(over), "g", "left_semi"), f"rows{k}")
        paths = scratch.write(_shared(rows), f"paths{k}")
        ends_of = paths.select("g", "shared", C("least").alias("parent"))
        rows = scratch.write(rows.drop("up", "parent").join(few_groups(ends_of), "g"), f"shared{k}")
        ended = rows.filter(F.size("turns") == C("shared")).select("g", "ends")
        big.append(scratch.write(paths.join(ended, "g", "left").na.fill(NO_IDS, ["ends"]), f"big{k}"))
        members = rows.filter(F.size("turns") > C("shared")).select(
            "n", "least", "turns", "ends", C("g").alias("up"), C("shared").alias("base"), "parent", _next_key(C("g"), C("turns"), C("shared")).alias("g")
        )

    def tops(nodes: DataFrame) -> DataFrame:
        return nodes.filter(C("depth") == C("base") + 1).select("up", "n_leaves", "saved_tokens")

    nodes, below = list(small), tops(small[-1])
    for k in reversed(range(len(big))):
        totals = below.groupBy(C("up").alias("g")).agg(F.count("*").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        nodes.append(scratch.write(_chain(big[k].join(totals, "g", "left").na.fill(0, ["below", "leaves", "saved"])), f"chain{k}"))
        below = tops(small[k]).union(tops(nodes[-1]))
    total = below.agg(F.count("*"), F.coalesce(F.sum("n_leaves"), F.lit(1)), F.coalesce(F.sum("saved_tokens"), F.lit(0))).first()
    top = spark.createDataFrame([(least, 0, None, n, *total, root["ends"] if root else NO_IDS)], NODE)
    found = reduce(DataFrame.unionByName, [x.drop("up", "base") for x in nodes], top)
    return found.withColumn("depth", C("depth").cast("long"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie's nodes over all conversations, each rebuilt with an opening of its group's first."""
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


# A prefix is a list of turns; a node's totals are sums over its members of what each, where it is the
# least member of a node, adds from there to its end.
ORACLE = r"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := COALESCE(role, ''), t := COALESCE(text, '')) ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT o.conv_id, o.turns, d.turns AS donor,
    (xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(o.conv_id::VARCHAR)), lambda i: ascii((o.conv_id::VARCHAR)[i + 1])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 4)::BIGINT AS h
  FROM own o LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % 20
), convs AS (
  SELECT conv_id, list_concat(COALESCE(donor[1:h], []), turns[h + 1:]) AS turns FROM headed
), prefixes AS (
  SELECT conv_id, turns, d AS depth, turns[1:d] AS p, turns[1:d - 1] AS q,
    CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(turns[d].t, '[ 	-]+'), lambda w: w <> '')) END AS words
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM convs)
), nodes AS (
  SELECT depth, p, any_value(q) AS q, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(turns)) = depth AS is_leaf, any_value(words) AS words,
    COALESCE(string_agg(CASE WHEN len(turns) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM prefixes GROUP BY depth, p
), gains AS (
  SELECT x.conv_id, x.depth, x.p,
    sum(CASE WHEN n.conv_id = x.conv_id THEN (n.n_convs - 1) * x.words ELSE 0 END) OVER w AS saved,
    sum(CASE WHEN n.conv_id = x.conv_id AND n.is_leaf THEN 1 ELSE 0 END) OVER w AS leaves
  FROM prefixes x JOIN nodes n ON n.depth = x.depth AND n.p = x.p
  WINDOW w AS (PARTITION BY x.conv_id ORDER BY x.depth DESC)
), sums AS (
  SELECT depth, p, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM gains GROUP BY depth, p
), children AS (
  SELECT depth - 1 AS depth, q AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, COALESCE(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.p = n.p
LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.p = n.q AND n.depth > 0
LEFT JOIN children c ON c.depth = n.depth AND c.p = n.p
"""
