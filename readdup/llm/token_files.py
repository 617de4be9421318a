"""Token ids in flat binary files.

A shard is two files: ``tokens-N.bin``, unsigned 16- or 32-bit little-endian ids, one document after another; and
``tokens-N.idx``: magic, bytes an id, number of documents, the n + 1 offsets of documents in ids (unsigned 64-bit) and
their doc_ids (signed 64-bit; the least number stands for null). Shards are ranges of doc_id, documents ascend in them,
so the whole corpus ascends over the shards' numbers and a shard's first position is the sum of the earlier shards' ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, slices, stored, table, tidy
from .pretok import Ragged, Units, split

MAGIC, NO_ID = b"RDTOKEN1", np.iinfo(np.int64).min
#: Distinct units that a worker remembers before it starts anew.
REMEMBERED = 3_000_000
#: Text bytes of a shard, about; documents whose ids are read at a time.
SHARD_BYTES, READ_DOCS = 64 << 20, 4096
_WROTE = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class Encoder:
    """Ids of whole texts as the tokenizers library gives them: each distinct unit is encoded by it once.

    A text that holds a special token's string goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.units = Units(self.make, self.clear, REMEMBERED)

    def clear(self) -> None:
        self.ids = Ragged(np.uint32)

    def make(self, words: list[str]) -> None:
        """Units of a space and letters keep their edges when joined, so the library takes many of them at a call."""
        joins = np.array([len(w) > 1 and w[0] == " " and w[1].isalpha() for w in words], bool)
        made, order = Ragged(np.uint32), np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        plain, others = [words[i] for i in order[: joins.sum()]], [words[i] for i in order[joins.sum() :]]
        for i in range(0, len(plain), 1024):
            found = self.library.encode("".join(plain[i : i + 1024]), add_special_tokens=False)
            made.append(np.array(found.ids, np.uint32), np.bincount(found.word_ids, minlength=len(plain[i : i + 1024])))
        for i in range(0, len(others), 1024):
            each = [e.ids for e in self.library.encode_batch_fast(others[i : i + 1024], add_special_tokens=False)]
            made.append(np.array([x for ids in each for x in ids], np.uint32), np.array([len(ids) for ids in each], np.int64))
        flat, at = made.rows(np.argsort(order))
        self.ids.append(flat, np.diff(at))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = [any(s in t for s in self.special) for t in texts]
        text, starts, ends, bounds, hashes = split(["" if s else t for s, t in zip(special, texts, strict=True)], bare=False)
        flat, at = self.ids.rows(self.units.find(text, starts, ends, hashes))
        at = at[bounds]
        out = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i, s in enumerate(special):
            if s:
                out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


@cache
def encoder(path: str) -> Encoder:
    """One per worker process, so that tasks share what is known of units."""
    return Encoder(path)


def place(folder: str) -> tuple[Any, str]:
    """The file system of a shared folder and the path in it."""
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_shard(folder: str, shard: int, parts: Iterator[tuple[list[int | None], list[np.ndarray]]], width: int) -> tuple[int, int]:
    """Write one shard from (doc_ids, ids) parts; how many documents and ids. Files appear under their names when whole, and a retry replaces them."""
    system, root = place(folder)
    system.create_dir(root, recursive=True)
    lengths: list[np.ndarray] = []
    names: list[np.ndarray] = []
    mark = f"{root}/.{shard}-{os.getpid()}"
    with system.open_output_stream(f"{mark}.bin") as out:
        for doc_ids, ids in parts:
            out.write(b"".join(x.astype(f"<u{width}").tobytes() for x in ids))
            lengths.append(np.array([len(x) for x in ids], np.uint64))
            names.append(np.array([NO_ID if d is None else d for d in doc_ids], np.int64))
    sizes = np.concatenate([np.zeros(1, np.uint64), *lengths])
    with system.open_output_stream(f"{mark}.idx") as out:
        out.write(MAGIC + np.array([width, len(sizes) - 1], "<u8").tobytes() + np.cumsum(sizes).astype("<u8").tobytes() + np.concatenate([np.empty(0, np.int64), *names]).astype("<i8").tobytes())
    for end in ("bin", "idx"):
        system.move(f"{mark}.{end}", f"{root}/tokens-{shard:06d}.{end}")
    return len(sizes) - 1, int(sizes.sum())


class Shard:
    """A shard's doc_ids and offsets, and its ids by ranges; ids are mapped into memory where the folder is mounted, else read range by range."""

    def __init__(self, folder: str, shard: int):
        system, root = place(folder)
        path = f"{root}/tokens-{shard:06d}"
        with system.open_input_file(f"{path}.idx") as f:
            index = np.frombuffer(f.read(), np.uint8)
        if index[:8].tobytes() != MAGIC:
            raise ValueError(f"{path}.idx is no index of token ids")
        self.width, n = (int(x) for x in index[8:24].view("<u8"))
        self.offsets = index[24 : 24 + 8 * (n + 1)].view("<u8").astype(np.int64)
        self.names = index[24 + 8 * (n + 1) :].view("<i8")
        self.file = system.open_input_file(f"{path}.bin") if not isinstance(system, pa.fs.LocalFileSystem) else None
        self.mapped = np.memmap(f"{path}.bin", f"<u{self.width}", "r") if self.file is None and self.offsets[-1] else None

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from one place of the shard to another."""
        if self.file is not None:
            return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")
        return self.mapped[start:stop] if self.mapped is not None else np.empty(0, f"<u{self.width}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all documents (doc_id, text); (shard, n_docs, n_ids), one row a file.

    Null texts are empty, null doc_ids come first; equal doc_ids stand in the order of their texts. ``width`` is the
    bytes of an id: 2 for vocabularies of up to 65,536 entries; ids that don't fit are an error. A shard is a range of
    doc_ids of about ``shard_bytes`` of text; a doc_id with more than that makes a longer shard.
    """
    if not 0 <= end_id < 1 << 8 * width:
        raise ValueError(f"the end id {end_id} doesn't fit into {width} bytes")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    ranged = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, shard = encoder(tokenizer), TaskContext.get().partitionId()
        if known.library.get_vocab_size(with_added_tokens=True) > 1 << 8 * width:
            raise ValueError(f"ids of {tokenizer} don't fit into {width} bytes")

        def parts() -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
            end = np.array([end_id], np.uint32)
            for batch in batches:
                for part in slices(batch):
                    ids = known.encode([t or "" for t in part.column(1).to_pylist()])
                    yield part.column(0).to_pylist(), [np.concatenate([x, end]) for x in ids]

        n_docs, n_ids = write_shard(folder, shard, parts(), width)
        if n_docs:
            yield table(_WROTE, shard=[shard], n_docs=[n_docs], n_ids=[n_ids])

    return ranged.mapInArrow(tidy(write), "shard long, n_docs long, n_ids long")


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; ``shards`` as write_tokens gave it."""
    based = shards.withColumn("base", F.sum("n_ids").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("n_ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = Shard(folder, shard)
                names, at = whole.names, whole.offsets
                for i in range(0, len(names), READ_DOCS):
                    stop = min(i + READ_DOCS, len(names))
                    ids, own = whole.ids(int(at[i]), int(at[stop])), (at[i : stop + 1] - at[i]).tolist()
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(own[:-1], own[1:], strict=True)]
                    yield table(_READ, doc_id=pa.array(names[i:stop], mask=names[i:stop] == NO_ID), start=base + at[i:stop], n_tokens=np.diff(at[i : stop + 1]), ids_crc32=sums)

    files = max(1, shards.count())  # one reading task a shard
    return based.select("shard", "base").repartition(files, "shard").mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids with id 0 after each, in files of 16-bit ids, read back."""
    import public_tokenizers

    folder = shared_dir(spark)
    wrote = stored(write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), 0))
    return read_tokens(wrote, folder)
