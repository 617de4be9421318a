"""Expressions over CIGAR strings. Coordinates are 1-based; an absent CIGAR is ``*``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(cigar: Column, pattern: str, group: int) -> Column:
    # the zero ahead: a cast that fails costs as much as a thousand that don't
    return F.coalesce(F.concat(F.lit("0"), F.regexp_extract(cigar, pattern, group)).try_cast("int"), F.lit(0))


def leading_clips(cigar: Column) -> Column:
    """Soft- and hard-clipped bases before the first aligned one."""
    pattern = r"^(?:(\d+)H)?(?:(\d+)S)?"
    return _number(cigar, pattern, 1) + _number(cigar, pattern, 2)


def trailing_clips(cigar: Column) -> Column:
    pattern = r"(?:(\d+)S)?(?:(\d+)H)?$"
    return _number(cigar, pattern, 1) + _number(cigar, pattern, 2)


def reference_length(cigar: Column) -> Column:
    """Reference bases that the alignment covers: the lengths of M, D, N, = and X."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0), lambda n, x: n + x.cast("int"))


def unclipped_start(pos: Column, cigar: Column) -> Column:
    return pos - leading_clips(cigar)


def unclipped_end(pos: Column, cigar: Column) -> Column:
    return pos + reference_length(cigar) - 1 + trailing_clips(cigar)


def unclipped_5prime(pos: Column, cigar: Column, reverse: Column) -> Column:
    """Where the read's first sequenced base would lie without clipping."""
    return F.when(reverse, unclipped_end(pos, cigar)).otherwise(unclipped_start(pos, cigar)).cast("long")
