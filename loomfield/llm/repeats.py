"""Removal of long byte strings that occur more than once, by a distributed suffix order.

1. Equal texts are one text. Texts are cut at anchors, bytes where a hash of the bytes around is
   least within ``reach`` neighbours; equal passages have the same anchors but for their ends. A
   chunk from anchor to anchor is a symbol. A repeated string of ``length`` bytes holds a row of
   chunks that each occur twice, so only such rows go on.
2. The suffixes of these rows are ordered by the difference-cover algorithm (``suffix_order``) and
   adjacent prefixes compared. Where ``length + reach`` bytes of chunks or more are a neighbour's
   prefix too, these bytes go: the order decides. Where fewer are, but as many as any repeated
   string must share, a repeat can begin or end within a chunk.
3. The strings of ``length`` bytes around such ends are compared by a fingerprint of all their
   bytes, with each other and with those of one of the texts that step 2 found alike.

Stretches of a period of up to 8 bytes have no anchors inside. A string in one stands again a period
further on; those that overlap its ends are all compared as in step 3.

Scale: all texts are read and cut once; what moves of them are chunk names, 12 bytes for some 65 of
text, and then only what repeats. Texts that have open ends move once, to be one row each however
many copies there are. Fingerprints travel packed, to parts of a bounded size: a packet sends each
once, and a task no more of those that it has seen to repeat, so a common passage does not fill a
part. Nothing that grows with the input is broadcast unless its size was checked; beyond
``MOST_NAMES`` repeated names they are joined instead.

Defined results: a null text counts as empty; texts shorter than ``length`` keep all. Repeated rows
are copies of each other. Spans are of bytes; ``whole_points`` moves them inwards to whole code points.
Texts are named by two 64-bit hashes, and chunks and strings compared by one. All columns of the
input are kept, whatever their names, in the struct ``row``. An empty table gives no rows. A text's
chunks are held by one task, and so are those of a row of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch, bounded, sliced, table
from loomfield.llm.suffix_order import flat, places, suffix_order

LENGTH = 400
LEAST_LENGTH = 48
GRAM = 8
#: Whether a place can be an anchor is told by the 8 bytes before it and the 16 from it on.
BEFORE, CONTEXT = 8, 24
#: Multiples of all periods up to 8.
PERIODS = (5, 6, 7, 8)
FEW = 300_000
MOST_NAMES = 1 << 22
SLICE = 1 << 15
PACKET = 1 << 20
PART = 1_000_000
KNOWN = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []

SPANS = "array<struct<a: int, b: int>>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def reach(length: int) -> int:
    """Neighbours among which an anchor is least: short enough that a string of ``length`` has a chunk."""
    if length < LEAST_LENGTH:
        raise ValueError(f"strings of fewer than {LEAST_LENGTH} bytes have no chunk")
    return min(128, (length - CONTEXT) // 3)


def shared_bytes(length: int) -> int:
    """The least bytes of whole chunks in any string of ``length`` that overlaps no periodic stretch much."""
    return length - CONTEXT - 2 * (reach(length) - 1)


def prefix_bytes(length: int) -> int:
    """The bytes of chunks that nominate an anchor: not all that must be shared, since the order need not tell suffixes further apart."""
    return 3 * shared_bytes(length) // 4


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        step, back = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        _powers[:] = [np.cumprod(step), np.cumprod(back)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Hashed:
    """Fingerprints of any substring of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = powers(len(data) + 1)
        self.sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(np.uint64) * _U(_BASE))


def sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every w neighbours, from those over powers of two."""
    span = 1
    out = x
    while 2 * span <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    n = len(x) - w + 1
    return op(out[:n], out[w - span : w - span + n]) if span < w else out


def anchors(data: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash is the least of some w neighbouring places; (first, last) of stretches of w places or more in a period."""
    n = len(data) - GRAM + 1
    nothing = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    if n < w:
        return nothing
    gram = np.empty(n, np.uint64)
    for k in range(GRAM):
        gram[k::GRAM] = data[k : k + (n - k + GRAM - 1) // GRAM * GRAM].view("<u8")
    inside = np.zeros(n, bool)
    for p in PERIODS:
        same = gram[p:] == gram[:-p]
        inside[p : n - p] |= same[p:] & same[: n - 2 * p]
    gram *= _U(_BASE)
    gram ^= gram >> _U(32)
    gram *= _U(_BASE)
    h = (gram >> _U(33)).astype(np.uint32)
    h[inside] = np.iinfo(np.uint32).max
    least = sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint32)
    found = np.flatnonzero((sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h) & ~inside)
    if not inside.any():
        return found, nothing[1]
    turn = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))).reshape(-1, 2)
    turn = turn[turn[:, 1] - turn[:, 0] >= w]
    return found, np.stack([turn[:, 0], turn[:, 1] - 1], 1)


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts) of slices of a column of texts without nulls, which Arrow lays end to end."""
    if not len(column):
        return
    _, ends, raw = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(raw, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, "right")) - 1)
        yield lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def identity(text: Column) -> tuple[Column, Column]:
    """Two hashes that name a text."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def distinct_texts(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(h1, h2, copies, t) of each text of ``length`` bytes or more; t: size, names of chunks, at (anchors), and what periodic stretches give to sure, open and must."""
    w = reach(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, starts in texts_of(b.column(0)):
                at, stretches = anchors(data, w)
                owner = np.searchsorted(starts, at, "right") - 1
                whole = owner[1:] == owner[:-1]
                names = Hashed(data)(at[:-1][whole], at[1:][whole])
                n = np.bincount(owner, minlength=hi - lo)
                sure, wide, must = ([[] for _ in range(hi - lo)] for _ in range(3))
                for u, v in stretches.tolist():
                    # A stretch goes through all texts that it touches.
                    for k in range(int(np.searchsorted(starts, u, "right")) - 1, int(np.searchsorted(starts, v + GRAM - 1, "right"))):
                        a, z = int(starts[k]), int(starts[k + 1])
                        first, end = max(u - min(PERIODS), a), min(v + GRAM + min(PERIODS), z)
                        if end - first >= length + max(PERIODS):
                            sure[k].append({"a": first - a, "b": end - a})
                            must[k].append({"a": first - a, "b": first - a + max(PERIODS) - 1})
                        wide[k].append({"a": max(u + w + CONTEXT - BEFORE - 1 - length, a) - a, "b": min(v - (w - 1) - BEFORE, z) - a})
                lists = lambda size, x: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), x)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(k).slice(lo, hi - lo) for k in (1, 2)),
                        pa.array(np.diff(starts), pa.int32()),
                        lists(np.maximum(n - 1, 0), pa.array(names.view(np.int64))),
                        lists(n, pa.array((at - starts[owner]).astype(np.int32))),
                        pa.array(sure, _SPANS),
                        pa.array(wide, _SPANS),
                        pa.array(must, _SPANS),
                    ],
                    names=["h1", "h2", "size", "names", "at", "sure", "open", "must"],
                )

    cut = texts.filter(F.octet_length("text") >= length).select("text", "h1", "h2")
    each = cut.mapInArrow(run, f"h1 long, h2 long, size int, names array<long>, at array<int>, sure {SPANS}, open {SPANS}, must {SPANS}")
    one = each.groupBy("h1", "h2").agg(F.first(F.struct("size", "names", "at", "sure", "open", "must")).alias("t"), F.count("*").alias("copies"))
    return scratch.write(one, "texts")


def repeated_names(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, n = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_pydict({"name": u.astype(np.int64), "n": np.minimum(n, 2).astype(np.int64)})

    each = texts.select("t.names").mapInArrow(run, "name long, n long")
    return each.groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1").select("name")


def name_filter(names: DataFrame, count: int) -> np.ndarray:
    """Bits set for ``count`` repeated names, 16 to 32 bits a name, by the first bits of a name; each block is made by one task."""
    log, block = max(21, math.ceil(math.log2(16 * max(1, count)))), 20

    def make(t: pa.Table) -> pa.Table:
        place = (t.column("name").to_numpy().view(np.uint64) >> _U(64 - log)).astype(np.int64) & ((1 << block) - 1)
        bits = np.zeros(1 << block, bool)
        bits[place] = True
        return pa.table({"block": t.column("block")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(1 << log >> 3, np.uint8)
    dealt = names.select("name", F.shiftrightunsigned("name", 64 - log + block).cast("int").alias("block"))
    for r in dealt.groupBy("block").applyInArrow(make, "block int, bits binary").collect():
        out[r["block"] << block >> 3 : (r["block"] + 1) << block >> 3] = np.frombuffer(r["bits"], np.uint8)
    return out


def rows_of_chunks(texts: DataFrame, names: DataFrame, length: int) -> DataFrame:
    """(h1, h2, rows) of texts with rows of repeated chunks: rows are (key, names, places of the anchors)."""
    count = names.count()
    least = prefix_bytes(length)
    kind = pa.list_(pa.struct([("key", pa.binary()), ("v", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]))
    if count <= MOST_NAMES:
        shared = texts.sparkSession.sparkContext.broadcast(name_filter(names, count))
        source = texts.select("h1", "h2", "t.names", "t.at")
    else:
        # Too many for a filter: the names meet the chunks in a join, and each text gets the places of its own.
        found = texts.select("h1", "h2", F.posexplode("t.names").alias("k", "name")).join(names, "name", "left_semi")
        places = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("k")).alias("k"))
        shared, source = None, texts.select("h1", "h2", "t.names", "t.at").join(places, ["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared else None
        for b in batches:
            v, at = (flat(b.column(c)) for c in (2, 3))
            n = b.column(2).value_lengths().to_numpy().astype(np.int64)
            start = np.cumsum(n) - n
            if bits is None:
                k = flat(b.column(4)).astype(np.int64)
                k += np.repeat(start, b.column(4).value_lengths().to_numpy())
            else:
                place = (v.view(np.uint64) >> _U(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
                k = np.flatnonzero((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
            if not len(k):
                continue
            # A text has an anchor more than chunks, if it has any.
            owner = np.searchsorted(start + n, k, "right")
            m = b.column(3).value_lengths().to_numpy().astype(np.int64)
            shift = (np.cumsum(m) - m - start)[owner]
            new = np.flatnonzero(np.r_[True, (np.diff(k) > 1) | (np.diff(owner) > 0)])
            end = np.r_[new[1:], len(k)] - 1
            lo, hi = k[new], k[end]
            long = at[hi + shift[end] + 1] - at[lo + shift[new]] >= least
            found: dict[int, list] = {}
            for t, x, y, z in zip(owner[new][long].tolist(), lo[long].tolist(), hi[long].tolist(), shift[new][long].tolist(), strict=True):
                names_in = v[x : y + 1]
                # Positive symbols, so that the end of a string is less than any.
                row = {"key": xxhash.xxh3_128_digest(names_in.tobytes()), "v": (names_in.view(np.uint64) >> _U(1)).astype(np.int64), "at": at[x + z : y + z + 2]}
                found.setdefault(t, []).append(row)
            if found:
                of = pa.array(list(found))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in (0, 1)), pa.array(list(found.values()), kind)], names=["h1", "h2", "rows"])

    return source.mapInArrow(run, "h1 long, h2 long, rows array<struct<key: binary, v: array<bigint>, at: array<int>>>")


def shared_anchors(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(key, rep, kept): for each distinct row of chunks its anchors (i, span, lead) whose next bytes also stand elsewhere.

    span: the bytes of chunks from the anchor on, ``length + reach`` or more, if a neighbour in the order begins with the same;
    else 0. lead: 1 for one of the neighbours that do. rep: h1 of one of the texts that have the row.
    """
    least, most = prefix_bytes(length), length + reach(length)
    each = rows.select("h1", F.explode("rows").alias("r")).select("h1", "r.key", F.col("r.v").alias("v"), F.expr("transform(sequence(1, size(r.v)), i -> cast(r.at[i] - r.at[i - 1] AS long))").alias("c"))
    one = each.groupBy("key").agg(F.first(F.struct("v", "c")).alias("x"), F.count("*").alias("times"), F.min("h1").alias("rep")).withColumn("sid", F.monotonically_increasing_id())
    strings = scratch.write(one.select("key", "rep", "sid", "x.v", "x.c", "times"), "strings")
    order = suffix_order(strings.select("sid", "v", "c"), least + reach(length), scratch)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, i, left = places(b.column(0), b.column(1))
            v, c, less = (flat(b.column(k)) for k in (1, 2, 4))
            times = np.repeat(b.column(3).to_numpy(), b.column(1).value_lengths().to_numpy())
            ends = np.concatenate([[0], np.cumsum(c)])
            last = np.arange(len(v)) + left
            up, down = powers(len(v) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v.view(np.uint64)) * up[: len(v)])])
            name = lambda a, z: mix((total[z] - total[a]) * down[a] + (z - a).astype(np.uint64) * _U(_BASE)).view(np.int64)
            stop = np.searchsorted(ends, ends[:-1] + least)  # the chunks j .. stop - 1 have that many bytes
            j = np.flatnonzero(stop <= last)
            far = np.searchsorted(ends, ends[j] + most)
            there = far <= last[j]
            far = np.where(there, far, j)
            g = np.where(there, name(j, far), 0)
            yield pa.RecordBatch.from_pydict({"less": less[j], "sid": sid[j], "i": i[j], "h": name(j, stop[j]), "g": g, "span": ends[far] - ends[j], "times": times[j]})

    kinds = "less long, sid long, i long, h long, g long, span long, times long"
    listed = strings.select("sid", "v", "c", "times").join(order, "sid").mapInArrow(prefixes, kinds)
    in_order = listed.repartitionByRange("less").sortWithinPartitions("less", "h", "g")

    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours of equal prefix; those at either end of a partition may go on in the next and are kept.

        Of a run of equal prefixes no more is held than its first row, until a second one comes.
        """
        held, known, edge = None, None, True

        def rows(m: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(np.r_[True, (m[1:, 3:5] != m[:-1, 3:5]).any(1)])
            many = np.repeat(np.add.reduceat(m[:, 6], at) > 1, np.diff(np.r_[at, len(m)]))
            lead = np.zeros(len(m), np.int64)
            lead[at] = 1
            return pa.RecordBatch.from_pydict({"sid": m[:, 1], "i": m[:, 2], "span": np.where(many, m[:, 5], 0), "lead": lead})

        for b in batches:
            m = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(7)], 1)
            if held is not None:
                m = np.concatenate([held, m])
            if not len(m):
                continue
            at = np.flatnonzero(np.r_[True, m[1:, 3] != m[:-1, 3]])
            keep = np.add.reduceat(m[:, 6], at) > 1
            keep[0] |= edge or known == m[0, 3]
            edge, held, known = False, None, m[-1, 3]
            if not keep[-1]:
                held, known = m[-1:], None
            m = m[np.repeat(keep, np.diff(np.r_[at, len(m)]))]
            if len(m):
                yield rows(m)
        if held is not None:
            yield rows(held)

    kept = in_order.mapInArrow(adjacent, "sid long, i long, span long, lead long").groupBy("sid").agg(F.collect_list(F.struct("i", "span", "lead")).alias("kept"))
    return strings.select("sid", "key", "rep").join(kept, "sid").select("key", "rep", "kept")


def open_texts(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(h1, h2, copies, sure, open, must): spans that go for sure, and ranges of starts of strings to compare.

    Strings in sure spans need no answer, but others may be compared with them. So of spans that are alike one text, by
    ``must``, compares what is in it; of a stretch in a period, the strings that begin in its first 8 bytes.
    """
    w = reach(length)
    chunked = scratch.write(rows_of_chunks(texts, scratch.write(repeated_names(texts), "names"), length), "rows")
    kept = shared_anchors(chunked, length, scratch)
    each = chunked.select("h1", "h2", F.explode("rows").alias("r")).select("h1", "h2", "r.key", "r.at").join(kept, "key")
    at = lambda x: F.get("at", x["i"].cast("int"))
    after = lambda x, n: (at(x) + x["span"] - n).cast("int")
    pairs = lambda which, a, b: F.transform(F.filter("kept", which), lambda x: F.struct(a(x).alias("a"), b(x).alias("b")))
    ranges = {
        "sure": pairs(lambda x: x["span"] > 0, at, lambda x: after(x, 0)),
        "open": pairs(lambda x: F.lit(True), lambda x: at(x) - (w - 1 + BEFORE), lambda x: at(x) - BEFORE),
        "must": pairs(lambda x: (x["span"] > 0) & (x["lead"] == 1) & (F.col("h1") == F.col("rep")), at, lambda x: after(x, length)),
    }
    placed = each.select("h1", "h2", *[c.alias(n) for n, c in ranges.items()]).groupBy("h1", "h2").agg(*[F.flatten(F.collect_list(n)).alias(n) for n in ranges])
    both = texts.select("h1", "h2", "copies", *[F.col(f"t.{n}").alias(f"{n}0") for n in ranges]).join(placed, ["h1", "h2"], "left")
    none = F.array().cast(SPANS)
    return both.select("h1", "h2", "copies", *[F.concat(F.coalesce(n, none), f"{n}0").alias(n) for n in ranges]).filter("size(open) > 0")


def covered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A mark for each of n places that some [a, b) holds."""
    mark = np.zeros(n + 1, np.int32)
    a, b = np.clip(a, 0, n), np.clip(b, 0, n)
    np.add.at(mark, a, 1)
    np.add.at(mark, np.maximum(a, b), -1)
    return np.cumsum(mark[:n]) > 0


def windows(size: int, ranges: dict[str, tuple[np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """Rows (a, b): ranges of starts, b not included, of the strings of a text that are to be compared."""
    n = size - length + 1
    (sure, sure_end), (start, end), (must, must_end) = (ranges[k] for k in ("sure", "open", "must"))
    mark = covered(n, start, end + 1) & ~covered(n, sure, sure_end + 1 - length) | covered(n, must, must_end + 1)
    return np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))).astype("<i4").reshape(-1, 2)


def starts_of(ranges: bytes) -> np.ndarray:
    x = np.frombuffer(ranges, "<i4").astype(np.int64).reshape(-1, 2)
    n = x[:, 1] - x[:, 0]
    return np.repeat(x[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def merged(sure: bytes, starts: np.ndarray, length: int) -> list[dict]:
    """The maximal spans of a text that sure spans and repeated strings cover."""
    spans = np.frombuffer(sure, "<i4").astype(np.int64).reshape(-1, 2)
    a, b = np.concatenate([starts, spans[:, 0]]), np.concatenate([starts + length, spans[:, 1]])
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return [{"a": s, "b": e} for s, e in zip(a[new].tolist(), b[np.r_[new[1:], len(a)] - 1].tolist(), strict=True)]


def repeated_spans(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(h1, h2, spans): the maximal byte spans to remove of each text that has any; ``texts`` has text, h1 and h2."""
    every = distinct_texts(texts, length, scratch)
    need = scratch.write(open_texts(every, length, scratch), "need")
    scratch.drop("names", "rows", "strings")
    keys = need.select("h1").distinct()
    few = keys.limit(FEW + 1).count() <= FEW
    # One row for each text, however many copies it has, and then the rest of what is known of it.
    near = texts.join(F.broadcast(keys) if few else keys, "h1", "left_semi").groupBy("h1", "h2").agg(F.first(F.encode("text", "UTF-8")).alias("raw"))
    kind = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("copies", pa.int64()), ("raw", pa.binary()), ("starts", pa.binary()), ("sure", pa.binary())]))

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """About a megabyte of texts in a row, named by partition and number."""
        k, held, size, n = 0, [], 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([n], pa.int64()), pa.array([held], kind)], names=["packet", "n", "texts"])
        for b in sliced(batches, 64):
            part = b.column(7)[0].as_py()
            known = list(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True))
            lists = {}
            for c, name in enumerate(("sure", "open", "must"), 4):
                values = b.column(c).flatten()
                stop = np.cumsum(b.column(c).value_lengths().to_numpy()).tolist()
                lists[name] = [0, *stop], *(values.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (0, 1))
            for j, (h1, h2, copies, raw) in enumerate(known):
                ranges = {name: (x[at[j] : at[j + 1]], y[at[j] : at[j + 1]]) for name, (at, x, y) in lists.items()}
                starts = windows(len(raw), ranges, length)
                a, z = ranges["sure"]
                sure = np.stack([a, z], 1).astype("<i4")
                held.append({"h1": h1, "h2": h2, "copies": copies, "raw": raw, "starts": starts.tobytes(), "sure": sure.tobytes()})
                size += len(raw)
                n += int((starts[:, 1] - starts[:, 0]).sum())
                if size >= PACKET:
                    yield row()
                    k, held, size, n = k + 1, [], 0, 0
        if held:
            yield row()

    # The partition is a column: a task that writes several partitions has one number for all of them.
    full = near.join(need, ["h1", "h2"]).select("h1", "h2", "copies", "raw", "sure", "open", "must", F.spark_partition_id().alias("part"))
    sent = scratch.write(full.mapInArrow(packets, "packet long, n long, texts array<struct<h1: bigint, h2: bigint, copies: bigint, raw: binary, starts: binary, sure: binary>>"), "packets")
    parts = max(16, math.ceil((sent.agg(F.sum("n")).first()[0] or 0) / PART))
    # Parts are ranges of fingerprints, so that what is sorted is dealt already.
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)

    def prints(texts_in: list[dict]) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each text the starts, and the fingerprints of all."""
        starts, out = [], [np.zeros(0, np.uint64)]
        for x in texts_in:
            s = starts_of(x["starts"])
            starts.append(s)
            if len(s):
                out.append(Hashed(np.frombuffer(x["raw"], np.uint8))(s, s + length))
        return starts, np.concatenate(out)

    def dealt(u: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.searchsorted(u, bounds), [len(u)]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct fingerprints of a packet by part, with a bit for those that it has twice; part -1: bits of what needs no answer."""
        known = np.zeros(0, np.uint64)
        for b in sliced(batches, 1):
            packet, h = b.column(0)[0].as_py(), prints(b.column(1)[0].as_py())[1]
            u, n = np.unique(h, return_counts=True)
            seen = np.isin(u, known, assume_unique=True)
            yield pa.RecordBatch.from_pydict({"part": [-1 - packet], "packet": [packet], "h": [np.packbits(seen).tobytes()], "twice": [b""]})
            u, n = u[~seen], n[~seen] > 1
            # What this task has sent as repeated once is never asked again.
            known = np.union1d(known if len(known) < KNOWN else known[:0], u[n])
            at = dealt(u)
            each = [(p, slice(at[p], at[p + 1])) for p in np.flatnonzero(np.diff(at)).tolist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([p for p, _ in each], pa.int64()),
                    "packet": pa.array([packet] * len(each), pa.int64()),
                    "h": pa.array([u[k].tobytes() for _, k in each], pa.binary()),
                    "twice": pa.array([np.packbits(n[k]).tobytes() for _, k in each], pa.binary()),
                }
            )

    def answer(t: pa.Table) -> pa.Table:
        """A bit for each fingerprint: whether it was sent twice, or as repeated."""
        if t.column("part")[0].as_py() < 0:
            return t.select(["packet", "part", "h"]).rename_columns(["packet", "part", "bits"])
        got = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
        size = [len(g) for g in got]
        h = np.concatenate(got)
        del got
        own = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("twice").to_pylist(), size, strict=True)]).astype(bool)
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(h), bool)
        twice[order] = np.r_[False, same] | np.r_[same, False]
        cut = np.split(twice | own, np.cumsum(size)[:-1])
        return pa.table({"packet": t.column("packet"), "part": t.column("part"), "bits": pa.array([np.packbits(x).tobytes() for x in cut], pa.binary())})

    asked = sent.select("packet", "texts").mapInArrow(ask, "part long, packet long, h binary, twice binary")
    bits = asked.groupBy("part").applyInArrow(answer, "packet long, part long, bits binary").groupBy("packet").agg(F.collect_list(F.struct("part", "bits")).alias("bits"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            texts_in, answers = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            starts, h = prints(texts_in)
            order = np.argsort(h)
            same = np.concatenate([[True], np.diff(h[order]) > 0])[: len(h)]
            u = h[order][same]
            bit = lambda x, n: np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=n).astype(bool)
            seen = next(bit(x, len(u)) for x in answers if x["part"] < 0)
            at, answered = dealt(u[~seen]), np.zeros(len(u) - seen.sum(), bool)
            for x in answers:
                if x["part"] >= 0:
                    lo, hi = at[x["part"]], at[x["part"] + 1]
                    answered[lo:hi] = bit(x, hi - lo)
            twice = seen.copy()
            twice[~seen] = answered
            found = np.zeros(len(h), bool)
            found[order] = twice[np.cumsum(same) - 1]
            k, rows = 0, []
            for x, s in zip(texts_in, starts, strict=True):
                s, k = s[found[k : k + len(s)]], k + len(s)
                if x["copies"] == 1 and (spans := merged(x["sure"], s, length)):
                    rows.append((x["h1"], x["h2"], spans))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), _SPANS))], names=["h1", "h2", "spans"])

    part_of = sent.join(bits, "packet").select("texts", "bits").mapInArrow(settle, f"h1 long, h2 long, spans {SPANS}")
    whole = every.filter("copies > 1").select("h1", "h2", F.array(F.struct(F.lit(0).alias("a"), F.col("t.size").alias("b"))).alias("spans"))
    spans = scratch.write(part_of.union(whole), "spans")
    scratch.drop("packets", "need", "texts")
    return spans


def with_spans(docs: DataFrame, length: int, text: str = "text") -> DataFrame:
    """(row, text, spans): the columns of ``docs`` as a struct, the text (null: empty), and the merged byte spans to remove, null where there are none."""
    scratch = Scratch(docs.sparkSession, "repeats")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("text"), *identity(body))
    spans = repeated_spans(rows.select("text", "h1", "h2"), length, scratch)
    few = spans.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(spans) if few else spans, ["h1", "h2"], "left").select("row", "text", "spans")


def cut(raw: bytes, spans: list[dict] | None) -> bytes:
    at, out = 0, []
    for x in spans or ():
        out.append(raw[at : x["a"]])
        at = x["b"]
    return b"".join([*out, raw[at:]])


def whole_points(raw: bytes, spans: list[dict]) -> list[dict]:
    """Spans moved inwards so that none begins or ends within a UTF-8 sequence."""
    out = []
    for x in spans:
        lo, hi = x["a"], x["b"]
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append({"a": lo, "b": hi})
    return out


def remaining(rows: DataFrame, points: bool = False) -> DataFrame:
    """(row, text, spans, kept) of rows with spans: the bytes that remain; ``points`` leaves whole code points. Other texts stay on the engine's side."""
    bounded(rows.sparkSession)

    @F.arrow_udf("binary")
    def rest(raw: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for x, s in zip(raw.to_pylist(), spans.to_pylist(), strict=True):
            out.append(None if s is None else cut(x, whole_points(x, s) if points else s))
        return pa.array(out, pa.binary())

    raw = F.encode("text", "UTF-8")
    return rows.select("row", "text", "spans", F.coalesce(rest(F.when(F.col("spans").isNotNull(), raw), F.col("spans")), raw).alias("kept"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the bytes covered by 400-byte strings that also start elsewhere."""
    rows = remaining(with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), LENGTH))
    none = F.array().cast(SPANS)
    spans = F.coalesce("spans", none)
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return rows.select(
        "row.doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
