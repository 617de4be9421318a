"""Predicates over the SAM flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 1, 4, 8, 16, 32, 64, 256, 512, 1024, 2048


def has(bit: int, flag: str | Column = "flag") -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(bit)) != 0


def is_candidate() -> Column:
    """Mapped and primary: the reads that are looked at for duplicates."""
    return F.col("flag").bitwiseAND(F.lit(UNMAPPED | SECONDARY | SUPPLEMENTARY)) == 0


def has_mate() -> Column:
    """Paired with a mapped mate."""
    return F.col("flag").bitwiseAND(F.lit(PAIRED | MATE_UNMAPPED)) == PAIRED
