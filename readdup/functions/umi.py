"""Unique molecular identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cigar import reference_length, unclipped_5prime
from .flags import FIRST, MATE_REVERSE, MATE_UNMAPPED, REVERSE, UNMAPPED, has

LEGAL = "^[ATCGNatcgn-]*$"
TOP, BOTTOM = "top", "bottom"


def template_strand(mate_cigar: Column) -> Column:
    """``top`` or ``bottom``, from flag, tid, pos, cigar, mtid, mpos and the mate's CIGAR; null where a read of the pair is unmapped.

    On one contig the strand is top if the first read's 5' end is not behind the other's; on two, if its contig comes first.
    """
    own = unclipped_5prime(F.col("pos"), F.col("cigar"), has(REVERSE))
    mate = unclipped_5prime(F.col("mpos"), mate_cigar, has(MATE_REVERSE))
    leads = F.when(F.col("tid") != F.col("mtid"), F.col("tid") < F.col("mtid")).otherwise(own <= mate)
    known = ~has(UNMAPPED) & ~has(MATE_UNMAPPED) & has(1)
    return F.when(known & leads.isNotNull(), F.when(has(FIRST) == leads, TOP).otherwise(BOTTOM))


def top_strand_umi(umi: Column, strand: Column, duplex: bool = True) -> Column:
    """The UMI as the top strand reads it: of a duplex UMI X-Y, the bottom strand's is Y-X.

    A missing UMI is empty. Letters other than A, C, G, T, N and ``-`` are an error, and so is a duplex UMI that is not
    empty without exactly one ``-``.
    """
    value = F.coalesce(umi, F.lit(""))
    wrong = F.raise_error(F.concat(F.lit("illegal characters in UMI: "), value)).cast("string")
    if not duplex:
        return F.when(value.rlike(LEGAL), value).otherwise(wrong)
    parts = F.split(value, "-")
    torn = F.raise_error(F.concat(F.lit("a duplex UMI must be of the form X-Y: "), value)).cast("string")
    turned = F.when(strand == BOTTOM, F.concat(F.element_at(parts, 2), F.lit("-"), F.element_at(parts, 1))).otherwise(value)
    return F.when(~value.rlike(LEGAL), wrong).when(value == "", value).when(F.size(parts) != 2, torn).otherwise(turned)


def molecular_identifier(contig: Column, strand: Column, duplex: bool = False, umi: str = "") -> Column:
    """``contig:position/umi``, with ``/A`` (top) or ``/B`` (bottom) for duplex UMIs of known strand.

    The position is the alignment's start on the reverse strand and its end on the forward one, 1-based.
    """
    at = F.when(has(REVERSE), F.col("pos")).otherwise(F.col("pos") + reference_length(F.col("cigar")) - 1)
    base = F.concat(contig, F.lit(":"), at.cast("string"), F.lit("/"), F.lit(umi))
    if not duplex:
        return base
    return F.concat(base, F.when(strand == TOP, "/A").when(strand == BOTTOM, "/B").otherwise(""))
