"""BAM files as a Spark data source: ``spark.read.format("bam")`` and ``df.write.format("bam")``.

A BAM file is a chain of small gzip members (blocks). Reading splits a file by compressed offsets: a split starts at the
first block at or behind its offset in which a chain of records starts, and ends where the next split does, so every
record is read once and no index is needed. A folder stands for its files in the order of their names, which have one
header. Writing makes a folder of whole files, one a partition; ``single`` joins them to one file instead, on the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .sam import SCHEMA

BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Row of a file: its split and place in it, then the reads' columns without ``idx``.
RAW = "part int, row long, " + SCHEMA.removeprefix("idx long, ")
#: How many records a split has.
COUNTS = "part int, n long"
SPLIT_BYTES, BLOCK_BYTES, LONGEST_RECORD = 32 << 20, 0xFF00, 1 << 26
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_FIXED = struct.Struct("<iiBBHHHiiii")
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


#: Bases as hexadecimal digits of their codes (any other letter is N) and back; qualities as characters and back.
_CODE_OF = bytes(ord(f"{BASES.index(chr(b)) if chr(b) in BASES else 15:x}") for b in range(256))
_BASE_OF = bytes.maketrans(b"0123456789abcdef", BASES.encode())
_LESS_33, _MORE_33 = bytes((i - 33) % 256 for i in range(256)), bytes((i + 33) % 256 for i in range(256))


def place(path: str) -> tuple[Any, str]:
    """The file system and the path in it, for URIs and local paths."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def block_size(head: bytes) -> int:
    """Compressed bytes of the block that starts with ``head`` (18 bytes or more); 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def blocks(f: Any, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the blocks from the first one at or behind ``start``."""
    f.seek(start)
    data, base = f.read(1 << 17), start
    if start:  # a block starts where a whole one follows its header
        at = data.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            n = block_size(data[at : at + 64])
            if n and (base + at + n == size or block_size(data[at + n : at + n + 64])):
                break
            at = data.find(b"\x1f\x8b\x08\x04", at + 1)
        if at < 0:
            return
        data, base = data[at:], base + at
    while True:
        if len(data) < 1 << 16:
            data += f.read(1 << 20)
        if not data:
            return
        n = block_size(data[:64])
        if not n or n > len(data):
            raise ValueError(f"no block of a BAM file at byte {base}")
        yield base, zlib.decompress(data[:n], 31)
        data, base = data[n:], base + n


def header_of(f: Any, size: int) -> tuple[list[str], list[str], int, int]:
    """The header's lines, the contigs' names, and the block and the place in it where records start."""
    data, starts = b"", []
    for offset, content in blocks(f, 0, size):
        starts.append((len(data), offset))
        data += content
        if len(data) < 12:
            continue
        if data[:4] != b"BAM\1":
            raise ValueError("not a BAM file")
        text, at = struct.unpack_from("<i", data, 4)[0], 8
        if len(data) < at + text + 4:
            continue
        lines = data[at : at + text].split(b"\0")[0].decode().splitlines()
        n, at = struct.unpack_from("<i", data, at + text)[0], at + text + 4
        names = []
        while len(names) < n and at + 4 <= len(data):
            size_of = struct.unpack_from("<i", data, at)[0]
            if at + 8 + size_of > len(data):
                break
            names.append(data[at + 4 : at + 3 + size_of].decode())
            at += 8 + size_of
        if len(names) == n:
            begin, block = next((s, b) for s, b in reversed(starts) if s <= at)
            return lines, names, block, at - begin
    raise ValueError("the BAM header is not whole")


def plausible(data: bytes, at: int, contigs: int, last: bool, most: int = 6) -> bool | None:
    """Whether records follow each other from here, as many as ``most`` or to the file's end (``last``: data reach it); None if that takes more data.

    One record that leads out of the data proves nothing: bytes that straddle two records can look like the head of a very long one.
    """
    for seen in range(most):
        if last and seen and at == len(data):
            return True
        if at + 36 > len(data):
            return False if last else None
        size, ref, pos, name, _, _, ops, _, bases, mate_ref, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
        end = at + 36 + name
        if not 32 <= size <= LONGEST_RECORD or not -1 <= ref < contigs or not -1 <= mate_ref < contigs or pos < -1 or mate_pos < -1 or name < 1 or bases < 0:
            return False
        if 32 + name + 4 * ops + (bases + 1) // 2 + bases > size or (end <= len(data) and (data[end - 1] != 0 or 0 in data[at + 36 : end - 1])):
            return False
        at += 4 + size
    return True if at <= len(data) else False if last else None


def decode(r: bytes) -> tuple:
    """The reads' columns of one record, without ``idx``."""
    ref, pos, n, mapq, _, ops, flag, bases, mate_ref, mate_pos, length = _FIXED.unpack_from(r)
    at = 32 + n
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", r, at)) or "*"
    at += 4 * ops
    packed = r[at : at + (bases + 1) // 2]
    seq = packed.hex().encode().translate(_BASE_OF)[:bases].decode() or "*"
    at += len(packed)
    quality = r[at : at + bases]
    qual = "*" if not bases or quality[0] == 255 else quality.translate(_MORE_33).decode()
    tags = tags_of(r, at + bases)
    return r[32 : 31 + n].decode(), flag, ref, pos + 1, mapq, cigar, mate_ref, mate_pos + 1, length, seq, qual, tags.get("RG", "  ")[2:] or None, tags


def tags_of(r: bytes, at: int) -> dict[str, str]:
    out = {}
    while at < len(r):
        name, kind = r[at : at + 2].decode(), chr(r[at + 2])
        at += 3
        if kind in _NUMBERS:
            (x,) = struct.unpack_from("<" + _NUMBERS[kind], r, at)
            at += struct.calcsize(_NUMBERS[kind])
            out[name] = f"{'f' if kind == 'f' else 'i'}:{x:g}" if kind == "f" else f"i:{x}"
        elif kind == "A":
            out[name] = f"A:{chr(r[at])}"
            at += 1
        elif kind in "ZH":
            end = r.index(0, at)
            out[name] = f"{kind}:{r[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            inner, n = chr(r[at]), struct.unpack_from("<i", r, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_NUMBERS[inner]}", r, at + 5)
            at += 5 + n * struct.calcsize(_NUMBERS[inner])
            out[name] = "B:" + ",".join([inner, *(f"{x:g}" if inner == "f" else str(x) for x in values)])
        else:
            raise ValueError(f"tag {name} has the unknown type {kind}")
    return out


def encode_tag(name: str, value: str) -> bytes:
    kind, x = value[0], value[2:]
    if kind == "i":
        return name.encode() + (b"i" + struct.pack("<i", int(x)) if -(1 << 31) <= int(x) < 1 << 31 else b"I" + struct.pack("<I", int(x)))
    if kind == "f":
        return name.encode() + b"f" + struct.pack("<f", float(x))
    if kind == "A":
        return name.encode() + b"A" + x[:1].encode()
    if kind == "B":
        inner, *values = x.split(",")
        return name.encode() + b"B" + inner.encode() + struct.pack(f"<i{len(values)}{_NUMBERS[inner]}", len(values), *(float(v) if inner == "f" else int(v) for v in values))
    return name.encode() + kind.encode() + x.encode() + b"\0"


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the index that holds the 0-based range."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def encode(row: Any) -> bytes:
    """One record, with its size before it."""
    ops, n, covered = [], "", 0
    for c in "" if row.cigar == "*" else row.cigar:
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | OPS.index(c))
            covered += int(n) if c in "MDN=X" else 0
            n = ""
    seq = "" if row.seq == "*" else row.seq
    packed = bytes.fromhex(seq.upper().encode("ascii", "replace").translate(_CODE_OF).decode() + "0" * (len(seq) % 2))
    qual = b"\xff" * len(seq) if row.qual == "*" else row.qual.encode("latin-1").translate(_LESS_33)
    name = row.qname.encode() + b"\0"
    tags = b"".join(encode_tag(k, v) for k, v in sorted((row.tags or {}).items()))
    at = row.pos - 1
    body = _FIXED.pack(row.tid, at, len(name), 255 if row.mapq is None else row.mapq, bin_of(max(at, 0), max(at, 0) + max(covered, 1)), len(ops), row.flag, len(seq), row.mtid, row.mpos - 1, row.tlen or 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def compressed(data: bytes) -> bytes:
    """The data as blocks, without the end mark."""
    out = []
    for i in range(0, len(data), BLOCK_BYTES):
        part = data[i : i + BLOCK_BYTES]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def encode_header(header: list[str], contigs: list[tuple[str, int]]) -> bytes:
    text = "".join(f"{x}\n" for x in header).encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for name, length in contigs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return compressed(out)


class Split(InputPartition):
    def __init__(self, number: int, file: str, start: int, stop: int):
        self.number, self.file, self.start, self.stop = number, file, start, stop


def files(path: str) -> list[tuple[str, int]]:
    """(file, size) of a BAM file, or of all in a folder in the order of their names."""
    system, inner = place(path)
    info = system.get_file_info(inner)
    if info.type != pyarrow.fs.FileType.Directory:
        return [(inner, info.size)]
    found = system.get_file_info(pyarrow.fs.FileSelector(inner))
    return sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith(".bam"))


class BamReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, count: bool):
        self.path, self.split_bytes, self.count = path, split_bytes, count

    def partitions(self) -> list[Split]:
        every = [(f, size, a) for f, size in files(self.path) for a in range(0, max(size or 0, 1), self.split_bytes)]
        return [Split(i, f, a, min(size, a + self.split_bytes)) for i, (f, size, a) in enumerate(every)]

    def read(self, split: Split) -> Iterator[tuple]:
        if self.count:
            yield (split.number, sum(1 for _ in self.records(split)))
        else:
            for row, record in enumerate(self.records(split)):
                yield (split.number, row, *decode(record))

    def records(self, split: Split) -> Iterator[bytes]:
        """The bytes of the records that start in a split."""
        system, path = place(self.path)[0], split.file
        size = system.get_file_info(path).size
        with system.open_input_file(path) as f:
            _, contigs, first, inner = header_of(f, size)
            start = first if split.start <= first else split.start
            if first >= split.stop:
                return
            data, at, stopped = b"", None, None
            tried, doubtful = 0, []  # places that were looked at for a record's start, and those of them that more data decide
            for offset, content in chain(blocks(f, start, size), [(size, b"")]):
                if stopped is None and offset >= split.stop:
                    stopped = len(data)  # records that start behind belong to the next split
                data += content
                if at is None and start == first:
                    at = inner
                if at is None:
                    limit = len(data) if stopped is None else stopped
                    places, doubtful, tried = chain(doubtful, range(tried, limit)), [], limit
                    for i in places:
                        found = plausible(data, i, len(contigs), offset >= size)
                        if found:
                            at = i
                            break
                        if found is None:
                            doubtful.append(i)
                    if at is None:
                        if stopped is not None and not doubtful:
                            return
                        continue
                while at + 4 <= len(data) and (stopped is None or at < stopped):
                    n = struct.unpack_from("<i", data, at)[0]
                    if at + 4 + n > len(data):
                        break
                    yield data[at + 4 : at + 4 + n]
                    at += 4 + n
                if stopped is not None and at >= stopped:
                    return
                if offset >= size and at < len(data):
                    raise ValueError(f"the last record of {path} is not whole")
                if at > 1 << 20:
                    data, at, stopped = data[at:], 0, None if stopped is None else stopped - at


class Wrote(WriterCommitMessage):
    def __init__(self, file: str | None, first: int):
        self.file, self.first = file, first


class BamWriter(DataSourceWriter):
    """A folder of whole files ``part-N.bam``, or one file that the driver joins from them."""

    def __init__(self, path: str, header: bytes, single: bool):
        self.path, self.header, self.single = path, header, single

    def folder(self) -> tuple[Any, str]:
        system, path = place(self.path)
        return system, f"{path}.parts" if self.single else path

    def write(self, rows: Iterator[Any]) -> Wrote:
        from pyspark import TaskContext

        system, folder = self.folder()
        system.create_dir(folder, recursive=True)
        number, held, size, first = TaskContext.get().partitionId(), [], 0, None
        name = f"{folder}/part-{number:06d}-{TaskContext.get().taskAttemptId()}.bam"
        with system.open_output_stream(name) as out:
            if not self.single:
                out.write(self.header)
            for row in rows:
                first = row.idx if first is None else first
                held.append(encode(row))
                size += len(held[-1])
                if size > 1 << 22:
                    whole = b"".join(held)
                    cut = len(whole) // BLOCK_BYTES * BLOCK_BYTES
                    out.write(compressed(whole[:cut]))
                    held, size = [whole[cut:]], len(whole) - cut
            out.write(compressed(b"".join(held)))
            if not self.single:
                out.write(END)
        return Wrote(name, number)

    def commit(self, messages: list[Wrote | None]) -> None:
        """Files of attempts that no message names are deleted, so that no record stands twice."""
        system, folder = self.folder()
        wrote = [m.file for m in sorted((m for m in messages if m and m.file), key=lambda m: m.first)]
        if not self.single:
            for x in system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
                if x.base_name.startswith("part-") and x.path not in wrote:
                    system.delete_file(x.path)
            return
        with system.open_output_stream(place(self.path)[1]) as out:
            out.write(self.header)
            for name in wrote:
                with system.open_input_stream(name) as part:
                    while chunk := part.read(1 << 22):
                        out.write(chunk)
            out.write(END)
        system.delete_dir(folder)

    def abort(self, messages: list[Wrote | None]) -> None:
        system, folder = self.folder()
        if system.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(folder)


class BamSource(DataSource):
    """Options: path; reading: split_bytes, count (false: records; true: their number in each split); writing: header (lines joined by line feeds), single (false)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return COUNTS if self.options.get("count") == "true" else RAW

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), self.options.get("count") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        from .header import contigs

        lines = self.options.get("header", "").split("\n")
        return BamWriter(self.options["path"], encode_header([x for x in lines if x], contigs(lines)), self.options.get("single") == "true")


def header(path: str) -> list[str]:
    """The header of a file, or of the first one of a folder."""
    found = files(path)
    if not found:
        raise ValueError(f"no BAM file in {path}")
    with place(path)[0].open_input_file(found[0][0]) as f:
        return header_of(f, found[0][1])[0]


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a BAM file or folder, numbered in file order by ``idx``: splits are counted first, without decoding, and their sums shift their rows."""
    spark.dataSource.register(BamSource)
    source = spark.read.format("bam").option("split_bytes", split_bytes)
    raw = source.load(path)
    base, shift = 0, []
    for part, n in sorted(tuple(r) for r in source.option("count", "true").load(path).collect()):  # a row a split
        shift.append((part, base))
        base += n
    of = spark.createDataFrame(shift, "part int, base long")
    return raw.join(F.broadcast(of), "part").withColumn("idx", F.col("base") + F.col("row")).select(*(f.name for f in StructType.fromDDL(SCHEMA)))


def write(reads: DataFrame, header: list[str], path: str, single: bool = False) -> None:
    """The reads in the order of ``idx``, range-partitioned, so that files in the order of their names are the whole."""
    reads.sparkSession.dataSource.register(BamSource)
    columns = [f.name for f in StructType.fromDDL(SCHEMA)]
    ordered = reads.select(*(F.col(c) if c in reads.columns else F.lit(None).alias(c) for c in columns)).repartitionByRange("idx").sortWithinPartitions("idx")
    ordered.write.format("bam").option("header", "\n".join(header)).option("single", str(single).lower()).mode("append").save(path)
