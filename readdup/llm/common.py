"""Shared pieces: tables in the cluster's shared folder, and batches of text for numpy."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove, shared_dir, stored

__all__ = ["documents", "flat", "remove", "shared_dir", "slices", "stored", "table", "tidy", "tidy_group", "words_of"]
#: Text bytes that one numpy batch holds at most, unless a single text is longer.
BATCH_BYTES = 2 << 20
#: Words are runs of anything but these bytes.
SPACES = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, in order; a longer text gets a part of its own."""
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and where each row starts, with the end last."""
    text = pa.compute.fill_null(text, b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    wide = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    _, places, data = text.buffers()
    at = np.frombuffer(places, dtype=wide, count=text.offset + len(text) + 1)[text.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def table(schema: pa.Schema, **columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def give_back() -> None:
    """Return to the system what arrow's pool and the C heap hold without use."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow. Its worker gives back memory at a task's end: it outlives the task, and idle ones count beside their executor's joins."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable:
    """tidy() for a function of one group, after each group."""

    def whole(group):
        out = run(group)
        give_back()
        return out

    return whole
