"""Token ids of a corpus in files that answer questions without being unpacked: a wavelet matrix per shard.

Ids are ranks among the shard's distinct ids. Plane by plane, from the highest bit, the matrix keeps one
bit of every rank, and orders the next plane by it: zeros first, then ones, each in their old order. With
the number of ones before every block of bits, rank and select on the planes give the id at a place, the
count of an id in a range and the places of an id, in a few blocks per plane. Blocks are deflated one by
one where that is shorter, so a file is compressed and yet read in places.

A shard is a file: a magic number, a length, a JSON header with the offsets of the sections, then ids and
lengths of its documents, its distinct ids, and for each plane the directory and the blocks. Shards hold
whole documents in ascending order of their ids; a longer document than a shard is a shard alone.

Scale: documents are encoded once and written; range partitions on id (and, where many rows share an id,
on what tells them apart) put them into order; a task cuts its sorted stream into shards and holds one at
a time. Files are written by Spark's own writer, one row a file, so they go to any store Spark writes
to, and tasks that are run again leave no second file. Where a shard's first token stands in the corpus
comes from the sums of shards and of partitions.

Defined results: null and empty texts are documents of just the end id. A null doc_id comes first.
Repeated rows are documents of their own, in the order of their ids' hash. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch, bounded, sliced, table
from loomfield.llm.word_ids import VOCABULARY, word_ids

MAGIC = b"LFWAVE01"
#: Tokens after which a shard is closed, bits of a block, and the id that ends a document.
SHARD, BITS, END = 1 << 20, 1 << 15, 1


def _packed(raw: bytes) -> bytes:
    """A block with a mark: deflated, or as it is where that is no longer."""
    small = zlib.compress(raw, 1)
    return b"\1" + small if len(small) < len(raw) else b"\0" + raw


def _raw(block: bytes) -> bytes:
    return zlib.decompress(block[1:]) if block[0] else block[1:]


def built(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int], part: int = 0, number: int = 0) -> bytes:
    """The file of a shard; ``ids`` of its documents in a row, ``sizes`` how many each has."""
    symbols = np.flatnonzero(np.bincount(ids, minlength=1))
    rank = np.zeros(1 << 16, np.uint16)
    rank[symbols] = np.arange(len(symbols))
    depth = max(0, int(len(symbols) - 1).bit_length())
    header = {"part": part, "number": number, "tokens": len(ids), "documents": len(doc_ids), "planes": []}
    sections, at = [], 0

    def add(raw: bytes) -> list[int]:
        nonlocal at
        sections.append(raw)
        at += len(raw)
        return [at - len(raw), len(raw)]

    known = np.array([x is not None for x in doc_ids], np.uint8)
    header["doc_ids"] = add(_packed(known.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes()))
    header["sizes"] = add(_packed(np.array(sizes, "<u4").tobytes()))
    header["symbols"] = add(_packed(symbols.astype("<u2").tobytes()))
    row = rank[ids]
    for level in reversed(range(depth)):
        bits = (row >> level & 1).astype(bool)
        blocks = [bits[lo : lo + BITS] for lo in range(0, len(bits), BITS)]
        ones = np.cumsum([0, *[int(b.sum()) for b in blocks]]).astype("<u4")
        stored = [_packed(np.packbits(b, bitorder="little").tobytes()) for b in blocks]
        offsets = np.cumsum([0, *[len(b) for b in stored]]).astype("<u4")
        header["planes"].append({"zeros": int(len(bits) - ones[-1]), "ones": add(ones.tobytes()), "offsets": add(offsets.tobytes()), "blocks": add(b"".join(stored))})
        row = np.concatenate([row[~bits], row[bits]])
    text = json.dumps(header).encode()
    return MAGIC + struct.pack("<I", len(text)) + text + b"".join(sections)


class Plane:
    """Bits with rank and select; blocks are unpacked when they are asked for."""

    def __init__(self, shard: Shard, spec: dict) -> None:
        self.zeros = spec["zeros"]
        self.ones = np.frombuffer(shard.section(spec["ones"]), "<u4").astype(np.int64)
        self.offsets = np.frombuffer(shard.section(spec["offsets"]), "<u4")
        self.blocks, self.size, self.at = shard.section(spec["blocks"]), shard.tokens, (-1, None)

    def block(self, k: int) -> np.ndarray:
        if self.at[0] != k:
            raw = np.frombuffer(_raw(bytes(self.blocks[self.offsets[k] : self.offsets[k + 1]])), np.uint8)
            self.at = (k, np.unpackbits(raw, count=min(BITS, self.size - k * BITS), bitorder="little").view(bool))
        return self.at[1]

    def bits(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.offsets) - 1)])

    def rank(self, i: int) -> int:
        """Ones before place ``i``."""
        k, rest = divmod(i, BITS)
        return int(self.ones[k]) + (int(self.block(k)[:rest].sum()) if rest else 0)

    def select(self, bit: int, which: np.ndarray) -> np.ndarray:
        """Places of the zeros or ones with these numbers, counted from 0 and ascending."""
        before = self.ones if bit else np.minimum(np.arange(len(self.ones)) * BITS, self.size) - self.ones
        block = np.searchsorted(before, which, side="right") - 1
        out = np.empty(len(which), np.int64)
        for k in np.unique(block):
            here = block == k
            out[here] = k * BITS + np.flatnonzero(self.block(k) == bool(bit))[which[here] - before[k]]
        return out


class Shard:
    """A shard's file, read in places."""

    def __init__(self, content: bytes) -> None:
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("no shard of token ids")
        (n,) = struct.unpack_from("<I", content, len(MAGIC))
        self.start = len(MAGIC) + 4 + n
        self.content, self.header = memoryview(content), json.loads(bytes(content[len(MAGIC) + 4 : self.start]))
        self.tokens, self.documents = self.header["tokens"], self.header["documents"]
        self.symbols = np.frombuffer(_raw(bytes(self.section(self.header["symbols"]))), "<u2")
        self.planes = [Plane(self, p) for p in self.header["planes"]]

    def section(self, place: list[int]) -> memoryview:
        return self.content[self.start + place[0] : self.start + place[0] + place[1]]

    def doc_ids(self) -> list[int | None]:
        raw = _raw(bytes(self.section(self.header["doc_ids"])))
        ids = np.frombuffer(raw, "<i8", offset=self.documents).tolist()
        return [x if raw[k] else None for k, x in enumerate(ids)]

    def sizes(self) -> np.ndarray:
        return np.frombuffer(_raw(bytes(self.section(self.header["sizes"]))), "<u4").astype(np.int64)

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        rank = 0
        for p in self.planes:
            bit, ones = bool(p.block(i // BITS)[i % BITS]), p.rank(i)
            rank = rank * 2 + bit
            i = p.zeros + ones if bit else i - ones
        return int(self.symbols[rank])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int, list[int]]:
        """Where the occurrences in a range stand below the last plane, and the bits that lead there."""
        rank = int(np.searchsorted(self.symbols, token))
        if rank == len(self.symbols) or self.symbols[rank] != token or lo >= hi:
            return 0, 0, []
        way = [rank >> k & 1 for k in reversed(range(len(self.planes)))]
        for p, bit in zip(self.planes, way):
            a, b = p.rank(lo), p.rank(hi)
            lo, hi = (p.zeros + a, p.zeros + b) if bit else (lo - a, hi - b)
        return lo, hi, way

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id at places from ``lo`` up to ``hi``."""
        a, b, _ = self._range(token, max(lo, 0), self.tokens if hi is None else min(hi, self.tokens))
        return b - a

    def places(self, token: int) -> np.ndarray:
        """All places of an id, ascending."""
        lo, hi, way = self._range(token, 0, self.tokens)
        at = np.arange(lo, hi)
        for p, bit in zip(reversed(self.planes), reversed(way)):
            at = p.select(bit, at - p.zeros if bit else at)
        return at

    def all(self) -> np.ndarray:
        """All ids in order: from the last plane up, zeros and ones go back to where they were."""
        row = np.zeros(self.tokens, np.uint16)
        for level, p in enumerate(reversed(self.planes)):
            bits, above = p.bits(), np.empty(self.tokens, np.uint16)
            above[~bits] = row[: p.zeros]
            above[bits] = row[p.zeros :] | np.uint16(1 << level)
            row = above
        return self.symbols[row]


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Each document's id and its token ids, the end id last, as little-endian 16-bit integers."""
    bounded(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tail = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(vocabulary)
        for b in sliced(batches, 2048):
            ids, sizes = encoder.encode(b.column(1))
            ends = np.cumsum(sizes)
            cut = [ids[e - n : e].tobytes() + tail for e, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids binary")


def write(tokens: DataFrame, folder: str, shard: int = SHARD) -> None:
    """Write rows of ``tokenised`` as shard files into a folder."""
    scratch = Scratch(tokens.sparkSession, "token-ids")
    rows = scratch.write(tokens.select("doc_id", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"), "ids"), "ids")
    by = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, doc_ids, part, number = [], [], 0, 0

        def file() -> pa.RecordBatch:
            sizes = [len(x) // 2 for x in ids]
            made = built(np.frombuffer(b"".join(ids), "<u2"), doc_ids, sizes, part, number)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["file"])

        held = 0
        for b in batches:
            for p, d, x in zip(*[c.to_pylist() for c in b.columns]):
                part = p
                ids.append(x)
                doc_ids.append(d)
                held += len(x) // 2
                if held >= shard:
                    yield file()
                    ids, doc_ids, held, number = [], [], 0, number + 1
        if ids:
            yield file()

    # The text writer puts a string's bytes down as they are, and one row a file.
    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "none").text(folder)
    scratch.drop()


def files(spark: SparkSession, folder: str) -> DataFrame:
    bounded(spark)
    return spark.read.format("binaryFile").load(folder).select("content")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a folder as its files have it: where it starts in the corpus, its size, and its ids' CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            shard = Shard(b.column(0)[0].as_py())
            ids, sizes = shard.all().astype("<u4"), shard.sizes()
            ends = np.cumsum(sizes)
            n = len(sizes)
            out = {
                "part": [shard.header["part"]] * n, "number": [shard.header["number"]] * n, "doc_id": pa.array(shard.doc_ids(), pa.int64()),
                "inside": ends - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, sizes)],
            }
            yield pa.RecordBatch.from_pydict(out)

    found = files(spark, folder).mapInArrow(run, "part long, number long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    rows = Scratch(spark, "token-rows").write(found, "rows")
    shards = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    # One row for each range partition: their number is a setting, whatever the table's size.
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_part = parts.select("part", earlier(Window.orderBy("part")).alias("before"))
    of_shard = shards.select("part", "number", earlier(Window.partitionBy("part").orderBy("number")).alias("in_part"))
    start = F.col("before") + F.col("in_part") + F.col("inside")
    return rows.join(of_shard.join(of_part, "part"), ["part", "number"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """Every place of some ids: document, place in it. Only their blocks are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            shard = Shard(b.column(0)[0].as_py())
            ends, doc_ids = np.cumsum(shard.sizes()), pa.array(shard.doc_ids(), pa.int64())
            for t in tokens:
                at = shard.places(t)
                doc = np.searchsorted(ends, at, side="right")
                first = np.concatenate([[0], ends])[doc]
                yield pa.RecordBatch.from_pydict({"token": pa.array([t] * len(at), pa.int64()), "doc_id": doc_ids.take(pa.array(doc)), "place": at - first})

    return files(spark, folder).mapInArrow(run, "token long, doc_id long, place long")


def counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """How often some ids occur: two ranks a plane in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            shard = Shard(b.column(0)[0].as_py())
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([shard.count(t) for t in tokens], pa.int64())})

    each = files(spark, folder).mapInArrow(run, "token long, n long")
    return each.groupBy("token").agg(F.sum("n").alias("n"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written as wavelet matrices in ascending order of doc_id and read back."""
    folder = Scratch(spark, "token-files").path("shards")
    write(tokenised(table(spark, sf_dir, "documents")), folder)
    return documents(spark, folder)
