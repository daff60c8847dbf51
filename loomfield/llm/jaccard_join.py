"""Exact self-join of documents by the Jaccard similarity of their word n-grams, in the metric space of 1 - J.

Documents with the same set of shingles become one class. A class's rarest shingles, as many as a
partner at the threshold cannot avoid, are its anchors; the classes that share an anchor form a
region around a pivot, the class that has the fewest rarer shingles before the anchor. A class is
replicated to the regions of all its anchors, so any two classes within the threshold share a region.

In a region every class is first compared with the pivot alone. With e = 1 - threshold and d the
distance to the pivot: classes within e of it are one component with it and need no comparison with
each other; two classes whose d differ by more than e cannot be linked, by the triangle inequality.
Regions whose classes are all in one component are done. The others join recursively, around a new
pivot, and after ``LEVELS`` levels the pairs that sizes, positions and distances leave are compared.

Which shingles are rare is told by a table of counts of fixed size, filled from all documents; it
only orders them, and any order gives the same links.

Scale: a document gives about (1 - threshold) of its shingles as rows. Comparisons are few and are
cut down by folded parity bitmaps, which bound a symmetric difference from below, before whole sets
are fetched. For components no region is expanded to all its pairs, and copies take part once; the
links themselves, of ``exact_links``, are compared inside a component too, in blocks of a region.

Defined results: texts without words, and null texts, have no shingles and are linked with nothing.
A text of fewer words than a shingle has one shingle, the whole sequence. Repeated rows and equal
sets are one class. Null ids are allowed: a component of only such rows has a null id. Ties go to
the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from loomfield.llm.common import Scratch, released, sliced, table
from loomfield.llm.components import components

LEVELS = 2
SKETCH = 20  # log2 of the counters
BLOCK = 16
FEW = 1_000_000
WORDS_KEPT = 50_000
PAIRS_AT_ONCE = 200_000
REGION_ROWS = 4096

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingles; words are ASCII-lowered and split at ASCII blanks."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > WORDS_KEPT:
            known.clear()
        # bytes.split and bytes.lower know exactly the ASCII blanks 9-13 and 32 and the letters A-Z.
        split = (text or "").encode("utf-8", "surrogatepass").lower().split()
        ids = []
        for w in split:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            ids.append(h)
        x = np.array(ids, dtype=np.uint64)
        n = min(self.words, len(x))
        if not n:
            return x
        h = np.full(len(x) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * _M[5] + x[k : len(x) - n + 1 + k] * _M[k % 5]
        return np.unique(mix(h))


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Hotness of each of 2^SKETCH buckets of shingles: how many times twice the mean, as a power of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, total = Shingler(words), np.zeros(1 << SKETCH, dtype="<u4")
        for b in sliced(batches):
            got = [cut(t) for t in b.column(0).to_pylist()]
            if got:
                total += np.bincount((np.concatenate(got) >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH).astype("<u4")
        if total.any():
            parts = total.reshape(-1, 1 << BLOCK)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "n": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<u4").astype("<u8") for x in t.column("n"))
        return pa.table({"block": t.column("block")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros(1 << SKETCH)
    # At most 2^(SKETCH - BLOCK) rows come back, whatever the input.
    for r in docs.select("text").mapInArrow(count, "block int, n binary").groupBy("block").applyInArrow(add, "block int, n binary").collect():
        counts[r["block"] << BLOCK : (r["block"] + 1) << BLOCK] = np.frombuffer(r["n"], "<u8")
    floor = max(16.0, 2 * counts.mean())
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / floor))).astype(np.uint8)


def parity_bitmap(s: np.ndarray) -> bytes:
    """Parities of the counts of shingles by their low bits; two such differ in no more places than the sets."""
    bits = 1 << int(np.clip(2 * len(s), 256, 16384) - 1).bit_length()
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference; the longer bitmap is folded by parity."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0)
    return int(np.unpackbits(x ^ y).sum())


def need(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection of sets of n and m shingles with J >= num / den, for integers or arrays of them."""
    return -((-num * (n + m)) // (num + den))


def classes(docs: DataFrame, words: int, num: int, den: int, hot: np.ndarray, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n, cls) and classes (k, cls, doc_id, n, anchors, bits); ``docs`` has doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, heat = Shingler(words), shared.value
        for part in sliced(batches):
            n, cls, anchors, bits = [], [], [], []
            for t in part.column(1).to_pylist():
                s = cut(t)
                order = np.argsort(heat[(s >> np.uint64(64 - SKETCH)).astype(np.int64)], kind="stable")
                first = len(s) + num * -len(s) // den if len(s) else 0  # len - ceil(t len)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                anchors.append(s[order[: first + 1]].view(np.int64))
                bits.append(parity_bitmap(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(anchors, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n", "cls", "anchors", "bits"])

    # Texts are read and cut once for all that follows but the last comparison of whole sets.
    full = scratch.write(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, n long, cls binary, anchors array<long>, bits binary"), "members")
    one = full.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("anchors").alias("anchors"), F.first("bits").alias("bits"))
    of_class = scratch.write(one.withColumn("k", F.monotonically_increasing_id()), "classes")
    return full.select("doc_id", "n", "cls"), of_class


def with_class(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the class ``cls`` of their text's set of shingles, null without words."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(words)
        for b in sliced(batches):
            s = [cut(t) for t in b.column(at).to_pylist()]
            cls = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in s], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, cls], names=[*b.schema.names, "cls"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("cls", BinaryType())]))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of whole regions from batches sorted by ``s``; a region that spans batches is put together."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        cols = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        s = cols["s"]
        if not len(s):
            continue
        last = np.searchsorted(s, s[-1])
        if last or (held and held[-1]["s"][-1] != s[0]):
            head = {n: np.concatenate([*(h[n] for h in held), c[:last]]) for n, c in cols.items()}
            held = []
            if len(head["s"]):
                yield head
            held.append({n: c[last:] for n, c in cols.items()})
        else:
            held.append(cols)
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
    held.clear()
    released()


def _starts(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, s[1:] != s[:-1]])


def regions(of_class: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, k, n, pos) of the anchors that two classes or more share, in partitions by s."""
    rows = of_class.select(F.posexplode("anchors").alias("pos", "s"), "k", "n").select("s", "k", "n", F.col("pos").cast("long"))
    dealt = rows.repartition("s").sortWithinPartitions("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            s = b.column(0).to_numpy()
            same = s[1:] == s[:-1]
            keep = np.r_[last is not None and bool(s[0] == last), same] | np.r_[same, False]
            if held is not None and keep[0] and s[0] == last:
                yield held
            held, last = None if keep[-1] else b.slice(len(s) - 1, 1), s[-1]
            yield b.filter(pa.array(keep))

    return scratch.write(dealt.mapInArrow(run, "s long, k long, n long, pos long"), "regions")


def pivots(rows: DataFrame, done: DataFrame | None) -> DataFrame:
    """(s, p, p_n, p_pos): each region's class with the fewest rarer shingles, of those that were no pivot of it yet."""
    if done is not None:
        rows = rows.join(done.select("s", F.col("p").alias("k")), ["s", "k"], "left_anti")
    best = rows.groupBy("s").agg(F.min(F.struct("pos", "k", "n")).alias("b"))
    return best.select("s", F.col("b.k").alias("p"), F.col("b.n").alias("p_n"), F.col("b.pos").alias("p_pos"))


def can(n: str, m: str, a: str, b: str, num: int, den: int):
    """Whether sizes and the places of a shared anchor leave room for the intersection that a link needs."""
    least = F.ceil(F.lit(num) * (F.col(n) + F.col(m)) / F.lit(num + den))
    left = F.least(F.col(n) - F.col(a), F.col(m) - F.col(b))
    return (F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)) & (left >= least)


def residual_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of a region that are in different components and that sizes, places and distances leave.

    ``rows``: s, k, n, pos, label and d, the distance to the pivot of the region's last round or NaN; regions of many
    classes are compared in blocks.
    """
    e = 1 - num / den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            at = _starts(g["s"])
            for lo, hi in zip(at, np.r_[at[1:], len(g["s"])], strict=True):
                label = g["label"][lo:hi]
                if (label == label[0]).all():
                    continue
                order = np.argsort(g["n"][lo:hi], kind="stable")
                n, left, k = (x[lo:hi][order] for x in (g["n"], g["n"] - g["pos"], g["k"]))
                d, label, block = g["d"][lo:hi][order], label[order], g["block"][lo:hi][order]
                # Of a pair the first has the smaller set: n_first from num / den of n up to what the places leave.
                lowest = np.searchsorted(n, -(-num * n // den), "left")
                highest = np.minimum(np.arange(len(n)), np.searchsorted(n, left * (num + den) // num - n, "right"))
                many = np.maximum(0, highest - lowest)
                i = 0
                while i < len(n):
                    j = i + max(1, int(np.searchsorted(np.cumsum(many[i:]), PAIRS_AT_ONCE, "right")))
                    y = np.repeat(np.arange(i, min(j, len(n))), many[i:j])
                    x = np.arange(len(y)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j]) + np.repeat(lowest[i:j], many[i:j])
                    ok = (label[x] != label[y]) & ((block[x] != block[y]) | (block[x] < 0)) & (left[x] >= need(n[x], n[y], num, den)) & ~(np.abs(d[x] - d[y]) > e + 1e-9)
                    if ok.any():
                        a, b = k[x[ok]], k[y[ok]]
                        yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})
                    i = j

    dealt = blocks(rows).repartition("s").sortWithinPartitions("s").select("s", "k", "n", "pos", "label", "d", "block")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, of_class: DataFrame, docs: DataFrame, words: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, d) of the pairs whose bitmaps do not rule a link out, with their exact distance."""
    side = lambda c: of_class.select(F.col("k").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"), F.col("doc_id").alias(f"{c}_id"), F.col("cls").alias(f"{c}_cls"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            # n + m less the symmetric difference is twice the intersection.
            keep = [n + m - apart(x, y) >= 2 * need(n, m, num, den) for n, m, x, y in zip(c["a_n"], c["b_n"], c["a_bits"], c["b_bits"], strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b", "a_cls", "b_cls", "a_id", "b_id"])

    id_kind = of_class.schema["doc_id"].dataType.simpleString()
    open_pairs = scratch.write(both.select("a", "b", "a_n", "b_n", "a_bits", "b_bits", "a_cls", "b_cls", "a_id", "b_id").mapInArrow(sift, f"a long, b long, a_cls binary, b_cls binary, a_id {id_kind}, b_id {id_kind}"), f"{name}-open")
    wanted = open_pairs.select(F.col("a_id").alias("doc_id"), F.col("a_cls").alias("cls")).union(open_pairs.select("b_id", "b_cls")).distinct()
    ids = wanted.select("doc_id").distinct()
    small = ids.limit(FEW + 1).count() <= FEW
    near = docs.alias("t").join((F.broadcast(ids) if small else ids).alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(words)
        for b in sliced(batches):
            s = [cut(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in s], pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], names=["cls", "shingles"])

    known = near.select("text").mapInArrow(sets, "cls binary, shingles binary").join(wanted.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    known = scratch.write(known, f"{name}-sets")
    full = open_pairs.select("a", "b", "a_cls", "b_cls").join(known.select(F.col("cls").alias("a_cls"), F.col("shingles").alias("x")), "a_cls").join(known.select(F.col("cls").alias("b_cls"), F.col("shingles").alias("y")), "b_cls")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 128):
            x, y = ([np.frombuffer(v, np.uint64) for v in part.column(k).to_pylist()] for k in (2, 3))
            i = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)])
            u = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)]) - i
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(1 - i / u, pa.float64()), pa.array(den * i >= num * u, pa.bool_())], names=["a", "b", "d", "linked"])

    return scratch.write(full.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long, d double, linked boolean"), f"{name}-pairs")


def blocks(rows: DataFrame) -> DataFrame:
    """Regions of more than ``REGION_ROWS`` classes as pairs of blocks of about so many, each with a name ``s`` of its own.

    Every pair meets in one: those of a block where it stands alone (``block`` -1), others where the two blocks stand
    together. Names that collide only add candidates.
    """
    hot = rows.groupBy("s").agg(F.ceil(F.count("*") / F.lit(REGION_ROWS)).cast("int").alias("m")).filter("m > 1")
    i = F.pmod(F.xxhash64("k"), F.col("m")).cast("int")
    place = lambda j: F.struct(F.xxhash64("s", F.least(i, j), F.greatest(i, j)).alias("s"), F.when(i == j, -1).otherwise(i).alias("block"))
    where = F.when(F.col("m").isNull(), F.array(F.struct("s", F.lit(-1).alias("block")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("m") - 1), place))
    dealt = rows.join(hot, "s", "left").withColumn("x", F.explode(where))
    return dealt.select("x.s", "x.block", *[c for c in rows.columns if c != "s"])


def exact_links(docs: DataFrame, words: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: members (doc_id, n_shingles, k) and all pairs (a, b, d) of classes with J >= num / den, a < b.

    Documents of one class are linked with each other too, at distance 0; k is null for texts without
    words. Pairs inside a component are compared like others, so they can be as many as its classes squared.
    """
    scratch = Scratch(docs.sparkSession, "links")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    members, of_class = classes(docs, words, num, den, sketch(docs, words), scratch)
    rows = regions(of_class, scratch).withColumn("label", F.col("k")).withColumn("d", F.lit(float("nan")))
    pairs = verified(residual_pairs(rows, num, den), of_class, docs, words, num, den, scratch, "links").filter("linked").select("a", "b", "d")
    return members.join(of_class.select("cls", "k"), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), "k"), pairs


def link_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, n_copies, n_links): how many other documents each document of a class is linked with."""
    size = members.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n_copies"))
    ends = pairs.select(F.col("a").alias("k"), F.col("b").alias("o")).union(pairs.select("b", "a"))
    more = ends.join(size.select(F.col("k").alias("o"), F.col("n_copies").alias("m")), "o").groupBy("k").agg(F.sum("m").alias("m"))
    return size.join(more, "k", "left").select("k", "n_copies", (F.col("n_copies") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))


def near_duplicates(docs: DataFrame, words: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, cls, root): linked are documents with J >= num / den; a row for every row.

    ``root`` names the component, also where ids are shared or null; it is null for texts without words.
    A caller that gives a ``scratch`` can drop it once the result is written.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    members, of_class = classes(docs, words, num, den, sketch(docs, words), scratch)
    rows = regions(of_class, scratch)

    links, distances, done = None, None, None
    labelled = rows.withColumn("label", F.col("k"))
    for level in range(LEVELS):
        # Regions of one component are finished.
        open_regions = labelled.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("s")
        active = scratch.write(labelled.join(open_regions, "s", "left_semi"), f"active-{level}")
        pivot = scratch.write(pivots(active, done), f"pivots-{level}")
        done = pivot if done is None else done.union(pivot)
        spokes = active.join(pivot, "s")
        pairs = spokes.filter((F.col("k") != F.col("p")) & can("n", "p_n", "pos", "p_pos", num, den)).select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b")).distinct()
        found = verified(pairs, of_class, docs, words, num, den, scratch, f"level-{level}")
        distances = found if distances is None else distances.union(found)
        new = found.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = new if links is None else links.union(new)
        root = components(links, scratch, f"labels-{level}")
        labelled = active.drop("label").join(root.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("root", "k")).drop("root")

    first = pivot.select("s", "p")
    spoke = distances.select(F.col("a").alias("k"), F.col("b").alias("p"), "d").union(distances.select("b", "a", "d")).groupBy("k", "p").agg(F.first("d").alias("d"))
    known = labelled.join(first, "s", "left").join(spoke, ["k", "p"], "left").select("s", "k", "n", "pos", "label", F.when(F.col("k") == F.col("p"), 0.0).otherwise(F.coalesce("d", F.lit(float("nan")))).alias("d"))
    rest = verified(residual_pairs(known, num, den), of_class, docs, words, num, den, scratch, "rest")
    links = links.union(rest.filter("linked").select("a", "b"))
    root = scratch.write(components(links, scratch, "final"), "roots")

    # The least id of a component, from its classes' least ids.
    with_root = of_class.select("cls", "k", "doc_id").join(root.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = with_root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = with_root.join(least, "root").select("cls", "component_id", "root")
    out = members.join(names, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "cls", "root")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are linked by 4-word shingles with J >= 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS n, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
cut AS (SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM docs),
one AS (SELECT n, len(s) AS k, unnest(s) AS s FROM cut),
links AS (SELECT a.n AS a, b.n AS b FROM one a JOIN one b ON a.s = b.s AND a.n <> b.n GROUP BY a.n, b.n HAVING 100 * count(*) >= 85 * (any_value(a.k) + any_value(b.k) - count(*))),
reach(n, m) AS (SELECT n, n FROM cut UNION SELECT reach.n, links.b FROM reach JOIN links ON reach.m = links.a)
SELECT c.doc_id, len(c.s)::BIGINT AS n_shingles, CASE WHEN len(c.s) = 0 THEN c.doc_id ELSE min(o.doc_id) END AS component_id FROM cut c JOIN reach USING (n) JOIN cut o ON o.n = reach.m GROUP BY c.n, c.doc_id, len(c.s)"""
