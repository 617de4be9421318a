"""ISO base media files: write bytes as uniform samples, walk boxes, decode sample tables, index keyframes.

The writer stores a payload as uncompressed 8-bit mono samples (``raw ``) of an audio track whose access units are
frames of ``FRAME`` bytes, so the stored form is lossless. The reader walks nested boxes and expands the sample tables
(sizes, chunks, times, sync samples) of each track to codec, duration and the byte ranges of keyframes, from headers
alone; payload bytes are touched only when a range is read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, table

FRAME, RATE, FILL, CHUNK = 576, 8000, 255, 64
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """The bytes, filled up to a positive multiple of FRAME."""
    return data + bytes([FILL]) * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def write(payload: bytes, key_every: int = 16) -> bytes:
    """A media file of the payload (a positive multiple of FRAME); every ``key_every``-th frame is a sync sample."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    duration = frames * FRAME
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    last = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + ([(chunks, last, 1)] if last != CHUNK or chunks == 1 else [])
    keys = np.arange(1, frames + 1, key_every, dtype=">u4")
    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    wide = len(payload) + (1 << 16) + 4 * frames >= 1 << 32

    def head(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ8xhhHH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0), _UNITY, struct.pack(">II", 0, 0), version=1, flags=7), media)
        return box(b"moov", full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, duration, 0x10000, 0x100), _UNITY, bytes(24), struct.pack(">I", 2), version=1), track)

    before = len(kind) + len(head(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return kind + head(before) + box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, stop: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, first byte, end) of each box's content, depth first. Boxes that overrun their parent raise ValueError."""
    stop = len(data) if stop is None else stop
    while start + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise ValueError(f"box {kind!r} at byte {start} has size {size}, {stop - start} bytes are left")
        yield (*path, kind), start + head, start + size
        if kind in NESTED:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    number: int = 0

    def key_ranges(self) -> list[tuple[int, int]]:
        """First byte and end of each keyframe."""
        return [(int(self.offsets[k]), int(self.offsets[k] + self.sizes[k])) for k in self.keys]


def expand(sizes: np.ndarray, runs: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Each sample's first byte from the samples' sizes, the (first chunk, samples a chunk, description) runs and the chunks' places."""
    if not len(sizes) or not len(runs):
        return np.empty(0, np.int64)
    of = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))))
    first = np.repeat(np.cumsum(of) - of, of)
    sums = np.append(0, np.cumsum(sizes))
    n = min(len(sizes), int(of.sum()))
    return (np.repeat(chunks, of)[:n] + sums[:n] - sums[first[:n]]).astype(np.int64)


def compact_sizes(view: memoryview, at: int) -> np.ndarray:
    """The samples' sizes of a compact table (stz2), in 4, 8 or 16 bits each."""
    bits, n = view[at + 7], struct.unpack_from(">I", view, at + 8)[0]
    if bits == 4:
        pairs = np.frombuffer(view, np.uint8, (n + 1) // 2, at + 12)
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)
    if bits not in (8, 16):
        raise ValueError(f"sample sizes of {bits} bits")
    return np.frombuffer(view, ">u1" if bits == 8 else ">u2", n, at + 12).astype(np.int64)


class Fragments:
    """Samples of movie fragments: runs (trun) behind track headers (tfhd), with the defaults of the movie (trex)."""

    def __init__(self) -> None:
        self.defaults: dict[int, tuple[int, int, int]] = {}  # duration, size, flags
        self.found: dict[int, list[np.ndarray]] = {}  # a row a sample: offset, size, duration, whether it is a keyframe
        self.start = self.track = self.place = self.base = 0
        self.own = (0, 0, 0)

    def header(self, view: memoryview, at: int) -> None:
        flags = int.from_bytes(view[at + 1 : at + 4], "big")
        self.track, at = struct.unpack_from(">I", view, at + 4)[0], at + 8
        self.base = self.place = self.start
        if flags & 1:
            self.base = self.place = struct.unpack_from(">Q", view, at)[0]
        at += 8 * bool(flags & 1) + 4 * bool(flags & 2)
        own = list(self.defaults.get(self.track, (0, 0, 0)))
        for i, bit in enumerate((8, 16, 32)):
            if flags & bit:
                own[i] = struct.unpack_from(">I", view, at)[0]
                at += 4
        self.own = tuple(own)

    def run(self, view: memoryview, at: int) -> None:
        flags, n = int.from_bytes(view[at + 1 : at + 4], "big"), struct.unpack_from(">I", view, at + 4)[0]
        at += 8
        if flags & 1:
            self.place = self.base + struct.unpack_from(">i", view, at)[0]
            at += 4
        first = struct.unpack_from(">I", view, at)[0] if flags & 4 else None
        at += 4 * bool(flags & 4)
        wide = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        cells = np.frombuffer(view, ">u4", n * len(wide), at).astype(np.int64).reshape(n, len(wide))
        duration, size, kind = (cells[:, wide.index(bit)] if bit in wide else np.full(n, own) for bit, own in zip((0x100, 0x200, 0x400), self.own, strict=True))
        kind = kind.copy()
        if first is not None and n:
            kind[0] = first
        offset = self.place + np.cumsum(size) - size
        self.place += int(size.sum())
        self.found.setdefault(self.track, []).append(np.stack([offset, size, duration, kind & 0x10000 == 0], 1))


def index(data: bytes) -> list[Track]:
    """The tracks of a media file, from its boxes alone, fragments behind the movie's own samples. A file that is cut off or malformed raises ValueError."""
    try:
        return _index(memoryview(data))
    except (struct.error, IndexError) as e:
        raise ValueError(f"the media file is cut off or malformed: {e}") from e


def _index(view: memoryview) -> list[Track]:
    tracks: list[Track] = []
    tables: dict[bytes, np.ndarray] = {}
    fragments = Fragments()

    def close() -> None:
        if tracks:
            t = tracks[-1]
            t.offsets = expand(t.sizes, tables.get(b"stsc", np.empty((0, 3), np.int64)), tables.get(b"stco", np.empty(0, np.int64)))
            t.keys = np.sort(tables[b"stss"] - 1) if b"stss" in tables else np.arange(len(t.sizes))
            tables.clear()

    for path, a, _ in walk(view):
        kind = path[-1]
        if kind == b"moof":
            fragments.start = a - 8
        elif kind == b"trex":
            number, _, *own = struct.unpack_from(">5I", view, a + 4)
            fragments.defaults[number] = tuple(own)
        elif kind == b"tfhd":
            fragments.header(view, a)
        elif kind == b"trun":
            fragments.run(view, a)
        if kind == b"trak":
            close()
            tracks.append(Track())
        if b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"tkhd":
            t.number = struct.unpack_from(">I", view, a + (20 if view[a] == 1 else 12))[0]
        elif kind == b"mdhd":
            wide = view[a] == 1
            t.timescale, t.duration = struct.unpack_from(">IQ" if wide else ">II", view, a + (20 if wide else 12))
        elif kind == b"hdlr":
            t.handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            t.codec = bytes(view[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", view, a + 4)
            t.sizes = np.full(n, size, np.int64) if size else np.frombuffer(view, ">u4", n, a + 12).astype(np.int64)
        elif kind == b"stz2":
            t.sizes = compact_sizes(view, a)
        elif kind in (b"stco", b"co64"):
            n = struct.unpack_from(">I", view, a + 4)[0]
            tables[b"stco"] = np.frombuffer(view, ">u4" if kind == b"stco" else ">u8", n, a + 8).astype(np.int64)
        elif kind == b"stsc":
            n = struct.unpack_from(">I", view, a + 4)[0]
            tables[kind] = np.frombuffer(view, ">u4", 3 * n, a + 8).astype(np.int64).reshape(n, 3)
        elif kind == b"stss":
            n = struct.unpack_from(">I", view, a + 4)[0]
            tables[kind] = np.frombuffer(view, ">u4", n, a + 8).astype(np.int64)
        elif kind == b"stts":
            n = struct.unpack_from(">I", view, a + 4)[0]
            steps = np.frombuffer(view, ">u4", 2 * n, a + 8).astype(np.int64).reshape(n, 2)
            each = np.repeat(steps[:, 1], steps[:, 0])
            t.times = np.cumsum(each) - each
    close()
    for t in tracks:
        if t.number in fragments.found:
            offset, size, duration, key = np.concatenate(fragments.found[t.number]).T
            before, at = len(t.sizes), t.duration if len(t.sizes) else 0
            t.offsets, t.sizes = np.concatenate([t.offsets, offset]), np.concatenate([t.sizes, size])
            t.keys = np.concatenate([t.keys, before + np.flatnonzero(key)])
            t.times = np.concatenate([t.times, at + np.cumsum(duration) - duration])
            t.duration = int(at + duration.sum())
    return tracks


def samples(data: bytes, t: Track) -> bytes:
    """The samples of a track, in order, as its sample tables place them; a place outside the file raises ValueError."""
    if not len(t.sizes):
        return b""
    if len(t.offsets) < len(t.sizes) or t.offsets.min() < 0 or int((t.offsets + t.sizes).max()) > len(data):
        raise ValueError("the sample tables point outside the file")
    joins = np.flatnonzero(t.offsets[1:] != t.offsets[:-1] + t.sizes[:-1]) + 1
    begins, ends = t.offsets[np.append(0, joins)], (t.offsets + t.sizes)[np.append(joins - 1, len(t.sizes) - 1)]
    return b"".join(data[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True))


def read(data: bytes) -> bytes:
    """The samples of the first track; a file without tracks raises ValueError."""
    tracks = index(data)
    if not tracks:
        raise ValueError("the media file has no track")
    return samples(data, tracks[0])


def feature(t: Track, payload: bytes) -> str:
    """Codec, seconds, samples, keyframes and their byte ranges' CRC, and the samples' mean and range, from what was read back."""
    keys = np.array(t.key_ranges(), "<i8")
    x = np.frombuffer(payload, np.uint8)
    return f"{t.handler}/{t.codec.strip()} {t.duration / t.timescale:.3f}s n={len(t.sizes)} keys={len(keys)}:{zlib.crc32(keys.tobytes()):08x} mean={x.mean():.4f} min={x.min()} max={x.max()}"


_COLUMNS = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
     ("feature", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of each document (doc_id, text): its padded UTF-8 bytes as a media file. Null texts are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield table(schema, doc_id=part.column(0), media=[write(padded((t or "").encode())) for t in part.column(1).to_pylist()])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def media_columns(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) through its media file and back: sizes, digests, sample-table columns and a feature.

    ``keyframes`` has the byte range of each keyframe in the file. Null and empty texts become one frame of fill bytes;
    an empty table gives an empty one. Rows keep their number; equal texts give equal values; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: list[list] = [[] for _ in _COLUMNS.names[1:]]
                for t in part.column(1).to_pylist():
                    data = (t or "").encode()
                    media = write(padded(data))
                    track = index(media)[0]
                    back = samples(media, track)
                    for column, x in zip(rows, (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(track, back), track.codec.strip(), track.duration / track.timescale, [{"start": a, "end": b} for a, b in track.key_ranges()]), strict=True):
                        column.append(x)
                yield table(_COLUMNS, doc_id=part.column(0), **dict(zip(_COLUMNS.names[1:], rows, strict=True)))

    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{f.name} {kinds.get(f.type, 'array<struct<start: long, end: long>>')}" for f in _COLUMNS))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored in an ISO media file and read back."""
    return media_columns(documents(spark, sf_dir))
