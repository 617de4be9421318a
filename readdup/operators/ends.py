"""Read ends: where a read's molecule begins, and what duplicate sets are keyed by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions.cigar import unclipped_5prime
from ..functions.flags import FIRST, PAIRED, REVERSE, has, has_mate, is_candidate
from ..functions.names import location
from ..functions.scoring import read_score
from ..functions.umi import template_strand, top_strand_umi

UNKNOWN_LIBRARY = "Unknown Library"
#: Strand pairs of two ends, as codes: F 0, R 1, FF 2, FR 3, RR 4, RF 5.
F_, R_, FF, FR, RR, RF = range(6)
BARCODES = ("barcode", "read_one_barcode", "read_two_barcode")


def orientation(first_reverse: Column, second_reverse: Column) -> Column:
    return F.when(first_reverse & second_reverse, RR).when(first_reverse, RF).when(second_reverse, FR).otherwise(FF)


def with_library(reads: DataFrame, read_groups: DataFrame) -> DataFrame:
    """Adds library and rg_ordinal. A read without read group, or of one without library, is of the unknown library; a
    group that the header lacks has the number after the last one. ``read_groups`` is the header's, so it is small."""
    groups = read_groups.select(F.col("rg_id").alias("_rg"), F.col("rg_ordinal").alias("_ordinal"), F.col("library").alias("_library"))
    joined = reads.drop("library", "rg_ordinal").join(F.broadcast(groups), F.col("rg") == F.col("_rg"), "left")
    ordinal = F.when(F.col("rg").isNull(), 0).otherwise(F.coalesce("_ordinal", F.lit(read_groups.count())))
    return joined.withColumn("library", F.coalesce("_library", F.lit(UNKNOWN_LIBRARY))).withColumn("rg_ordinal", ordinal.cast("int")).drop("_rg", "_ordinal", "_library")


def tag_value(reads: DataFrame, tag: str | None) -> Column:
    """A tag's text, from the tag map or a column of the tag's name in lower case; null where the tag is unset or absent."""
    if not tag:
        return F.lit(None).cast("string")
    if "tags" in reads.columns:
        return F.substring(F.col("tags")[tag], 3, 1 << 30)
    return F.col(tag.lower()) if tag.lower() in reads.columns else F.lit(None).cast("string")


def read_ends(reads: DataFrame, read_groups: DataFrame, options: Options) -> DataFrame:
    """One row for each mapped primary read, with nothing of it but what duplicate detection needs."""
    named = with_library(reads.where(is_candidate()), read_groups)
    place = location(F.col("qname"), options.read_name_regex)
    one, two = tag_value(reads, options.read_one_barcode_tag), tag_value(reads, options.read_two_barcode_tag)
    is_one = ~has(PAIRED) | has(FIRST)
    if options.duplex_umi and options.barcode_tag:
        barcode = top_strand_umi(tag_value(reads, options.barcode_tag), template_strand(tag_value(reads, "MC")), duplex=True)
    else:
        barcode = tag_value(reads, options.barcode_tag)
    return named.select(
        "idx", "qname", "rg", "library", "rg_ordinal", F.col("tid").alias("ref"),
        unclipped_5prime(F.col("pos"), F.col("cigar"), has(REVERSE)).alias("coord"), has(REVERSE).alias("reverse"),
        read_score(options.duplicate_scoring_strategy).alias("score"), has_mate().alias("has_mate"), F.when(has_mate(), F.col("mtid")).otherwise(-1).alias("mate_ref"),
        has(FIRST).alias("first"), *(c.alias(n) for n, c in place.items()),
        barcode.alias("barcode"), F.when(is_one, one).alias("read_one_barcode"), F.when(~is_one, two).alias("read_two_barcode"),
    )
