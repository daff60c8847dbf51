"""Media columns: files of the ISO base media format, written and read box by box.

``store`` puts a payload into such a file as one track of raw 8-bit samples; ``inspect`` walks the
nested boxes of any such file, decodes the sample tables of its tracks and returns codec, duration
and the byte ranges of the key frames. It never decodes a payload: sizes and offsets suffice.

Scale: one narrow Arrow pass over whole values, a file at a time, with no shuffle.

Defined results: null and empty payloads are stored as one block of filling. A file that is cut
short, or in which a box claims more bytes than its parent has, raises ``ValueError`` in ``walk``;
``media_columns`` gives null ``tracks`` for it and a message in ``error``, and so for files in fragments. Repeated rows each give a
row; equal payloads give equal files. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import bounded, sliced, table

BLOCK = 576
RATE = 8000
GROUP = 8  # a key frame every so many samples
CHUNK = 16  # samples in a chunk of the file
#: Boxes that hold only boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"))
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(payload: bytes, block: int = BLOCK, rate: int = RATE) -> bytes:
    """A file of one sound track: every block of the payload is a sample of raw unsigned bytes."""
    if not payload or len(payload) % block:
        raise ValueError("the payload must be a positive number of blocks")
    samples = len(payload) // block
    chunks = -(-samples // CHUNK)
    duration = len(payload)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso6mp41")

    def moov(first: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
        stsc = [(1, CHUNK, 1)] if samples >= CHUNK else []
        if samples % CHUNK:
            stsc.append((chunks, samples % CHUNK, 1))
        keys = range(1, samples + 1, GROUP)
        stbl = box(
            b"stbl",
            full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, 0, struct.pack(">III", 1, samples, block)),
            full_box(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", 0, 0, struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            full_box(b"stsz", 0, 0, struct.pack(">II", block, samples)),
            full_box(b"co64", 0, 0, struct.pack(f">I{chunks}Q", chunks, *range(first, first + len(payload), CHUNK * block))),
        )
        url = full_box(b"url ", 0, 1)
        minf = box(b"minf", full_box(b"smhd", 0, 0, bytes(4)), box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), url)), stbl)
        mdhd = full_box(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, rate, duration, 0x55C4, 0))
        hdlr = full_box(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"bytes\0")
        tkhd = full_box(b"tkhd", 1, 3, struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8))
        mvhd = full_box(b"mvhd", 1, 0, struct.pack(">QQIQIH", 0, 0, rate, duration, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    first = len(head) + len(moov(0)) + 16
    return head + moov(first) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of body, end of body) of every box, parents first; sizes 0 (to the end) and 1 (64 bits) included."""
    end = len(data) if end is None else end
    while at < end:
        if at + 8 > end:
            raise ValueError(f"a box is cut short at byte {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"a box is cut short at byte {at}")
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at byte {at} claims {size} bytes")
        yield (*path, kind), body, at + size
        if kind in CONTAINERS:
            yield from walk(data, body, at + size, (*path, kind))
        at += size


@dataclass
class Track:
    """What the sample tables of one track say."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    keys: list[int] | None = None

    def ranges(self, only_keys: bool = False) -> list[tuple[int, int]]:
        """(first byte, bytes) of the samples or of the key frames; without a key table every sample is one."""
        at = range(len(self.sizes)) if not only_keys or self.keys is None else [k - 1 for k in self.keys]
        return [(self.offsets[k], self.sizes[k]) for k in at]


def inspect(data: bytes) -> list[Track]:
    """The tracks of a file, from its boxes alone."""
    tracks: list[Track] = []
    chunk_at: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def close() -> None:
        if not tracks:
            return
        t, k = tracks[-1], 0
        for j, (first, per, _) in enumerate(runs):
            last = runs[j + 1][0] if j + 1 < len(runs) else len(chunk_at) + 1
            for c in range(first - 1, last - 1):
                at = chunk_at[c]
                for _ in range(per):
                    t.offsets.append(at)
                    at += t.sizes[k]
                    k += 1
        if k != len(t.sizes):
            raise ValueError("the sample tables disagree")

    for path, at, end in walk(data):
        kind, inside = path[-1], path[-2] if len(path) > 1 else b""
        if kind == b"moof":
            raise ValueError("its samples are in fragments, which have no sample tables")
        if kind == b"trak":
            close()
            tracks.append(Track())
            chunk_at, runs = [], []
        if not tracks or inside not in (b"mdia", b"stbl"):
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        elif kind == b"hdlr":
            t.handler = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd":
            t.codec = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"stsz":
            one, n = struct.unpack_from(">II", data, at + 4)
            t.sizes = [one] * n if one else list(struct.unpack_from(f">{n}I", data, at + 12))
        elif kind == b"stss":
            t.keys = list(struct.unpack_from(f">{struct.unpack_from('>I', data, at + 4)[0]}I", data, at + 8))
        elif kind == b"stsc":
            runs = list(struct.iter_unpack(">III", data[at + 8 : end]))
        elif kind in (b"stco", b"co64"):
            n = struct.unpack_from(">I", data, at + 4)[0]
            chunk_at = list(struct.unpack_from(f">{n}{'I' if kind == b'stco' else 'Q'}", data, at + 8))
    close()
    return tracks


def filled(text: str | None, block: int = BLOCK) -> tuple[int, bytes]:
    """The number of UTF-8 bytes, and these bytes filled with bytes 255 up to a positive number of blocks."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % block or block * (not raw))


def media_columns(media: DataFrame, column: str, carry: list[str]) -> DataFrame:
    """Of each file in ``column`` the tracks: handler, codec, duration in seconds and key-frame byte ranges."""
    kinds = {f.name: f.dataType for f in media.schema.fields}
    bounded(media.sparkSession)
    media = media.select(*carry, F.col(column).alias("_media"))
    ranges = pa.list_(pa.struct([("at", pa.int64()), ("bytes", pa.int64())]))
    kind = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("key_frames", ranges)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            tracks, errors = [], []
            for data in b.column(len(carry)).to_pylist():
                try:
                    found = inspect(data or b"")
                    if not found:
                        raise ValueError("it has no track")
                    row = [{"handler": t.handler, "codec": t.codec, "seconds": t.duration / max(t.timescale, 1), "key_frames": [{"at": a, "bytes": n} for a, n in t.ranges(True)]} for t in found]
                    tracks.append(row)
                    errors.append(None)
                except (ValueError, IndexError, struct.error) as e:
                    tracks.append(None)
                    errors.append(f"not a readable file: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(tracks, kind), pa.array(errors, pa.string())], names=[*carry, "tracks", "error"])

    head = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in carry)
    track = "struct<handler: string, codec: string, seconds: double, key_frames: array<struct<at: bigint, bytes: bigint>>>"
    return media.mapInArrow(run, head + f"tracks array<{track}>, error string")


FIELDS = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def digest(text: str | None) -> tuple:
    """Store a text, read the stored bytes back through the sample tables, and describe both."""
    n, payload = filled(text)
    data = store(payload)
    t = inspect(data)[0]
    back = b"".join(data[a : a + k] for a, k in t.ranges())
    keys = t.ranges(True)
    spans = hashlib.sha256(",".join(f"{a}+{k}" for a, k in keys).encode()).hexdigest()[:16]
    feature = f"{t.codec.strip()};{t.timescale};{t.duration};{len(t.sizes)} samples;{len(keys)} key frames;{spans}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a media file, read back through its sample tables, and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [digest(x) for x in b.column(1).to_pylist()]
            made = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", *(name for name, _ in FIELDS)])

    spec = f"doc_id {id_kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.mapInArrow(run, spec)
