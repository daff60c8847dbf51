"""Encoding and decoding with merge-type sentence-piece vocabularies.

A text's blanks become the mark U+2581 and it is cut before every mark that follows another
character; no piece of the vocabulary spans such a cut, so words can be encoded one by one. A word
starts as single characters. An agenda holds its adjacent pairs that are pieces, by score, the
leftmost first among equals; the best pair is merged and its new neighbours enter the agenda, until
none is left. Characters without a piece become their UTF-8 bytes' pieces.

The distinct words of an Arrow batch are looked up; each of those not seen before is encoded and
compared with what the library makes of it, and should the two differ, the library's ids stand. A
text's ids are gathered from those of its words.

Scale: one narrow Arrow pass over whole texts; a worker remembers a bounded number of words.

Defined results: null and empty texts have just the end id and decode to an empty text. Repeated
rows each give a row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import bounded, sliced, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 300_000
#: Words beyond this length take their agenda from a heap.
LONG = 48
#: Words that take their rounds together.
TOGETHER = 8192
ROWS = 512


@cache
def processor(name: str = MODEL):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


class Ranks:
    """Pairs of symbols to ranks: an open-addressing table that is searched for many pairs at once."""

    def __init__(self, of: dict[int, int], never: int) -> None:
        bits = max(4, (4 * len(of)).bit_length())
        self.shift, self.mask, self.never = np.uint64(64 - bits), (1 << bits) - 1, never
        self.key, self.rank = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        pairs, ranks = np.fromiter(of, np.int64, len(of)), np.fromiter(of.values(), np.int64, len(of))
        for x, r, at in zip(pairs.tolist(), ranks.tolist(), self._place(pairs).tolist(), strict=True):
            while self.key[at] >= 0:
                at = (at + 1) & self.mask
            self.key[at], self.rank[at] = x, r

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        at = self._place(pairs)
        there = self.key[at]
        out = np.where(there == pairs, self.rank[at], self.never)
        todo = np.flatnonzero((there != pairs) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.key[at[todo]]
            hit = there == pairs[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out


class PieceAgenda:
    """The vocabulary's merges, and the agenda that orders them: for one word, or for many words a round at a time."""

    def __init__(self, name: str = MODEL) -> None:
        sp = self.sp = processor(name)
        self.size = size = sp.get_piece_size()
        pieces = [sp.id_to_piece(k) for k in range(size)]
        merged = [k for k in range(size) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        self.id = {pieces[k]: k for k in merged}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece spans a word boundary")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        score = {k: sp.get_score(k) for k in merged}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        # Every way to make a piece out of two: left * size + right gives the rank. Symbols without a piece are
        # numbered from size * size on, so that no sum with one is a key.
        two = [
            (self.id[p[:j]] * size + self.id[p[j:]], rank[score[k]], k)
            for p, k in self.id.items()
            for j in range(1, len(p))
            if p[:j] in self.id and p[j:] in self.id
        ]
        self.rank = {pair: r for pair, r, _ in two}
        self.never = len(rank)
        self.ranks = Ranks(self.rank, self.never)
        # What a rank makes, or -1 where several pieces have the rank; for these the pair tells.
        makes: dict[int, set[int]] = {}
        for _, r, k in two:
            makes.setdefault(r, set()).add(k)
        self.result = np.array([next(iter(x)) if len(x := makes.get(r, {-1})) == 1 else -1 for r in range(len(rank))], np.int64)
        self.tied = {pair: k for pair, r, k in two if len(makes[r]) > 1}
        self.single = np.full(0x110000, -1, np.int32)
        for p, k in self.id.items():
            if len(p) == 1:
                self.single[ord(p)] = k

    def encode_all(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words of a batch that are not long take their rounds together, like lengths in one block."""
        if not words:
            return []
        out: list[list[int]] = [[] for _ in words]
        n = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.cumsum(n) - n
        sym = self.single[code].astype(np.int64)
        odd = np.flatnonzero(sym < 0)
        sym[odd] = self.size * self.size + code[odd]
        for k in np.flatnonzero(n > LONG).tolist():
            out[k] = self.encode(words[k])
        order = np.flatnonzero((n > 0) & (n <= LONG))
        order = order[np.argsort(n[order], kind="stable")]
        for lo in range(0, len(order), TOGETHER):
            own = order[lo : lo + TOGETHER]
            ends = np.cumsum(n[own])
            take = np.repeat(at[own] - (ends - n[own]), n[own]) + np.arange(ends[-1])
            ids, size = self._rounds(sym[take], ends - n[own])
            ids, stop = ids.tolist(), np.cumsum(size).tolist()
            for k, a, b in zip(own.tolist(), [0, *stop], stop):
                out[k] = ids[a:b]
        for k in np.unique(np.searchsorted(at, odd, "right") - 1).tolist():
            out[k] = self._close(out[k])
        return out

    def _rounds(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of symbols laid end to end, each of one at least. A round merges the best pair of every word.

        The agenda has for each place rank << 32 | place of the pair that begins there, so that the least of
        a word is its best pair, the leftmost among equals.
        """
        n, size, none = len(sym), self.size, self.never << 32
        right, left = np.arange(1, n + 2), np.arange(-1, n)
        right[np.r_[start[1:], n] - 1] = n
        left[start] = n
        agenda = np.full(n + 1, none, np.int64)
        first = np.flatnonzero(right[:n] < n)
        agenda[first] = self.ranks(sym[first] * size + sym[first + 1]) << 32 | first
        sym = np.append(sym, 0)
        alive = np.ones(n, bool)
        while True:
            best = np.minimum.reduceat(agenda[:n], start)
            best = best[best < none]
            if not len(best):
                return sym[:n][alive], np.add.reduceat(alive.astype(np.int64), start)
            i, made = best & 0xFFFFFFFF, self.result[best >> 32]
            j = right[i]
            for x in np.flatnonzero(made < 0).tolist():
                made[x] = self.tied[int(sym[i[x]] * size + sym[j[x]])]
            after, before = right[j], left[i]
            sym[i], alive[j], agenda[j] = made, False, none
            right[i], left[after] = after, i
            agenda[i] = np.where(after < n, self.ranks(made * size + sym[after]) << 32 | i, none)
            ok = before < n
            p = before[ok]
            agenda[p] = self.ranks(sym[p] * size + made[ok]) << 32 | p

    def encode(self, word: str) -> list[int]:
        """Ids of one word, by a heap of (rank, place): a long word costs its length times the logarithm."""
        base, size, get = self.size * self.size, self.size, self.rank.get
        s = [k if (k := self.id.get(c)) is not None else base + ord(c) for c in word]
        right, left = [*range(1, len(s)), -1], [-1, *range(len(s) - 1)]
        agenda = [(r, i, s[i], s[i + 1]) for i in range(len(s) - 1) if (r := get(s[i] * size + s[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            r, i, a, b = heappop(agenda)
            j = right[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue  # one of the two was merged meanwhile
            s[i], s[j], right[i] = int(self.result[r]) if self.result[r] >= 0 else self.tied[a * size + b], -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := get(s[x] * size + s[y])) is not None:
                    heappush(agenda, (r, x, s[x], s[y]))
        return self._close([k for k in s if k >= 0])

    def _close(self, row: list[int]) -> list[int]:
        base, out = self.size * self.size, []
        for x in row:
            if x < base:
                out.append(x)
            else:
                out += [self.byte[b] for b in chr(x - base).encode("utf-8", "surrogatepass")]
        return out


class PieceCodec:
    """Encoder of batches of whole texts; remembers a bounded number of words with their ids."""

    CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")

    def __init__(self, name: str = MODEL) -> None:
        self.agenda = PieceAgenda(name)
        self.sp = self.agenda.sp
        self.eos = self.sp.eos_id()
        self.decimal = [str(k) for k in range(self.agenda.size)]
        # Two generations: what is looked up moves to the younger, and the elder goes when that is full.
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def words(self, texts: pa.Array) -> pa.Array:
        """For each text its words, without the mark that each begins with; joined by marks they are the text."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}"))
        # What a filter gives has no offset: of a slice the split would not keep it.
        simple = pc.split_pattern(texts.filter(plain), " ")
        odd = [[] if not t else [w[1:] for w in self.CUT.split(MARK + t.replace(" ", MARK))] for t in texts.filter(pc.invert(plain)).to_pylist()]
        every = pa.concat_arrays([simple, pa.array(odd, pa.list_(pa.string()))])
        place = np.empty(len(texts), np.int64)
        ok = plain.to_numpy(zero_copy_only=False)
        place[ok], place[~ok] = np.arange(ok.sum()), np.arange(ok.sum(), len(texts))
        return every.take(pa.array(place))

    def learn(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the words, which differ. Those not seen before are encoded, and each is compared with the library."""
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        ids = [young.get(w) for w in words]
        for k in [k for k, x in enumerate(ids) if x is None and words[k] in old]:
            ids[k] = young[words[k]] = old[words[k]]
        new = [k for k, x in enumerate(ids) if x is None]
        if new:
            got = self.agenda.encode_all([MARK + words[k] for k in new])
            # The library puts the first mark itself; a lone mark needs a text around it.
            want = self.sp.encode([words[k] or "a" + MARK for k in new], num_threads=1)
            for k, a, b in zip(new, got, want, strict=True):
                # Should the two ever differ, what the library says stands.
                ids[k] = young[words[k]] = a if a == b or not words[k] and a == b[1:] else b if words[k] else b[1:]
        return ids

    def encode(self, texts: pa.Array) -> list[list[int]]:
        """For each text its ids, the end id last."""
        words = self.words(texts)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        known = words.flatten().dictionary_encode()
        ids = self.learn(known.dictionary.to_pylist())
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        # The ids of word after word of the batch, gathered from those of the distinct words.
        at = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = n[at]
        stop = np.concatenate([[0], np.cumsum(size)])
        every = flat[np.repeat((np.cumsum(n) - n)[at] - stop[:-1], size) + np.arange(stop[-1])]
        cut = stop[ends]
        out = [every[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for x in out:
            x.append(self.eos)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1)


def encoded(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), name: str = MODEL) -> DataFrame:
    """The ``carry`` columns with ``ids`` (array of int, the end id last) and ``decoded``."""
    bounded(docs.sparkSession)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    docs = docs.select(*carry, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(name)
        for part in sliced(batches, ROWS):
            ids = codec.encode(part.column(len(carry)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(codec.decode(ids), pa.string())], names=[*carry, "ids", "decoded"])

    return docs.mapInArrow(run, kinds + "ids array<int>, decoded string")


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text with the end id, and the text decoded from them, as counts and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec()
        for part in sliced(batches, ROWS):
            ids = codec.encode(part.column(1))
            made = (
                pa.array(map(len, ids), pa.int64()),
                pa.array([hashlib.sha256(" ".join([codec.decimal[k] for k in x]).encode()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in codec.decode(ids)], pa.string()),
            )
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {id_kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
