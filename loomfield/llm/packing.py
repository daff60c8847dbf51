"""Packing of tokenised documents into fixed-length training sequences.

Documents are dealt to groups at random; each group is packed on its own by first-fit decreasing.
A tournament tree over the free room of the open sequences finds the first that fits in
logarithmic time. What exceeds a sequence is cut: a document of 2500 ids gives two full sequences
and a rest of 452, and only rests are packed. After that the sequences that stayed short are cut
open once more: the emptiest are dissolved into the room that is left in the others, so that a
group leaves at most one sequence that is not full.

Scale: the number of groups grows with the rows and with their bytes, so a group has a bounded number
of documents and, but for a single long one, of bytes, however many rows share an id, a source or a text. Token ids travel once, as 16-bit integers, to
the groups; no group sees another.

Defined results: null and empty texts are documents of just the end id. Repeated rows are documents
of their own, with pieces of their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import bounded, sliced, table

ROOM = 1024
GROUP_DOCS = 2048
GROUP_BYTES = 16 << 20
VOCABULARY = "byte_bpe_50k.json"
CHECK_EVERY = 997


class TournamentTree:
    """Free room of the bins as leaves; an inner node has the largest room below it."""

    def __init__(self, bins: int, room: int) -> None:
        self.size = 1 << max(0, (bins - 1)).bit_length()
        self.node = [room] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """The first bin with room for ``need``; its room shrinks by that."""
        node, at = self.node, 1
        if node[1] < need:
            raise ValueError("no bin has room")
        while at < self.size:
            at *= 2
            if node[at] < need:
                at += 1
        found = at - self.size
        node[at] -= need
        at //= 2
        while at:
            node[at] = max(node[2 * at], node[2 * at + 1])
            at //= 2
        return found


def pack(lengths: list[int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group; lengths are positive.

    Sequences are gapless from offset 0, and all but the last are full: the sequences that
    first-fit decreasing leaves short give their pieces, cut where need be, to one another.
    """
    pieces, rests, sequence = [], [], 0
    for k, n in enumerate(lengths):
        for start in range(0, n - n % room, room):
            pieces.append((k, start, room, sequence, 0))
            sequence += 1
        if n % room:
            rests.append((n % room, k))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree = TournamentTree(len(rests), room)
    bins: list[list[tuple[int, int, int]]] = []
    for n, k in rests:
        at = tree.first_fit(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((k, lengths[k] - n, n))
    full, short = [], []
    for b in bins:
        (full if sum(x[2] for x in b) == room else short).append(b)
    # The fullest stay whole; the emptiest are cut into what they lack.
    short.sort(key=lambda b: -sum(x[2] for x in b))
    used = [sum(x[2] for x in b) for b in short]
    lo, hi = 0, len(short) - 1
    while lo < hi:
        if used[lo] == room:
            lo += 1
            continue
        if not short[hi]:
            hi -= 1
            continue
        k, start, n = short[hi].pop()
        m = min(n, room - used[lo])
        short[lo].append((k, start, m))
        used[lo] += m
        used[hi] -= m
        if m < n:
            short[hi].append((k, start + m, n - m))
    for b in [*full, *short]:
        offset = 0
        for k, start, n in b:
            pieces.append((k, start, n, sequence, offset))
            offset += n
        sequence += bool(b)
    return pieces


@cache
def reference_tokenizer(name: str = VOCABULARY):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(public_tokenizers.path(name))


class Ids:
    """A text's ids as little-endian 16-bit integers.

    The merges of the vocabulary file are run by the compiled encoder that takes ranks, which is
    several times faster than the file's own library. Texts that hold an added token of the file go
    to that library, and every so often ``encode`` compares the two; after a difference the library
    encodes all that follows.
    """

    def __init__(self, name: str = VOCABULARY) -> None:
        import tiktoken

        vocabulary = reference_tokenizer(name).get_vocab(with_added_tokens=False)
        if len(vocabulary) > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        # The public byte-level alphabet writes printable bytes as themselves, the others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(byte[c] for c in token): k for token, k in vocabulary.items() if token != "<|endoftext|>"}
        self.encoder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library, self.seen, self.differs = reference_tokenizer(name), 0, False
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if self.differs or any(t in text for t in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        ids = self.encoder.encode_to_numpy(text, disallowed_special=())
        self.seen += 1
        if self.seen % CHECK_EVERY == 1:
            want = np.array(self.library.encode(text, add_special_tokens=False).ids, ids.dtype)
            self.differs = not np.array_equal(want, ids)
            ids = want
        return ids.astype("<u2").tobytes()


def tokenised(docs: DataFrame, carry: list[str], text: str = "text", end: int = 0) -> DataFrame:
    """The ``carry`` columns with ``ids``: a document's 16-bit ids and the end id, as bytes."""
    bounded(docs.sparkSession)
    docs = docs.select(*carry, F.col(text).alias("_text"))
    tail = np.array([end], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Ids()
        for part in sliced(batches):
            ids = [words.encode(x or "") + tail for x in part.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=[*carry, "ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{kinds}, ids binary")


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", room: int = ROOM, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's own ids as little-endian 32-bit integers."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    groups = max(1, math.ceil(rows / group_docs), math.ceil(size / GROUP_BYTES))
    # A row's place in the scan is its random number: rows that are alike still go to different groups.
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("g"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, "<u2").astype("<u4") for x in batch.column("ids").to_pylist()]
        first = (batch.column("g")[0].as_py()) << 32
        rows = pack([len(x) for x in ids], room)
        cut = [ids[k][s : s + n].tobytes() for k, s, n, _, _ in rows]
        at = pa.array([r[0] for r in rows], pa.int64())
        out = {
            "doc_id": batch.column("doc_id").combine_chunks().take(at),
            "start": [r[1] for r in rows],
            "length": [r[2] for r in rows],
            "ids_crc32": [zlib.crc32(x) for x in cut],
            "doc_tokens": [len(ids[r[0]]) for r in rows],
            "sequence_id": [first + r[3] for r in rows],
            "offset": [r[4] for r in rows],
        }
        return pa.table(out | ({"ids": pa.array(cut, pa.binary())} if with_ids else {}))

    return tokenised(dealt, ["doc_id", "g"]).groupBy("g").applyInArrow(run, f"doc_id {kind}, {PIECES}" + ", ids binary" * with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packed(table(spark, sf_dir, "documents"))
