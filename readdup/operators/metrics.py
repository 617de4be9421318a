"""Per-library duplication metrics, library size, return on sequencing and set-size histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import MATE_UNMAPPED, PAIRED, SECONDARY, SUPPLEMENTARY, UNMAPPED, has

COUNTS = ("UNPAIRED_READS_EXAMINED", "READ_PAIRS_EXAMINED", "SECONDARY_OR_SUPPLEMENTARY_RDS", "UNMAPPED_READS", "UNPAIRED_READ_DUPLICATES", "READ_PAIR_DUPLICATES")
#: Bisection steps for the library size; powers of ten tried for its upper bound.
STEPS, TENS = 40, 12
ROI_POINTS = 100


def raw_counts(marked: DataFrame) -> DataFrame:
    """One row a library of reads with library and is_duplicate; pairs are counted by reads here.

    A read counts once: as unmapped, secondary or supplementary, unpaired, or paired. Only mapped primary duplicates count as such.
    """
    unmapped, other = has(UNMAPPED), F.col("flag").bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) != 0
    single = ~has(PAIRED) | has(MATE_UNMAPPED)
    primary = ~unmapped & ~other
    conditions = (primary & single, primary & ~single, ~unmapped & other, unmapped, primary & single & F.col("is_duplicate"), primary & ~single & F.col("is_duplicate"))
    return marked.groupBy("library").agg(*(F.count_if(c).alias(n) for n, c in zip(COUNTS, conditions, strict=True)))


def lander_waterman(ratio: Column, pairs: Column, unique: Column) -> Column:
    """C/X - 1 + exp(-N/X) at X = ratio * C, which falls through zero at the library's size."""
    x = ratio * unique
    return unique / x - 1 + F.exp(-pairs / x)


def library_size(pairs: Column, unique: Column) -> Column:
    """Distinct molecules of a library from its read pairs and its distinct pairs, by bisection; null without duplicates.

    An upper bound is found in powers of ten, then 40 halvings follow; all in one expression without a UDF.
    """
    n, c = pairs.cast("double"), unique.cast("double")
    high = F.aggregate(F.sequence(F.lit(1), F.lit(TENS)), F.lit(100.0), lambda m, _: F.when(lander_waterman(m, n, c) > 0, m * 10).otherwise(m))

    def halve(s: Column, _: Column) -> Column:
        r = (s["low"] + s["high"]) / 2
        u = lander_waterman(r, n, c)
        done = s["done"] | (u == 0)
        return F.struct(
            F.when(~done & (u > 0), r).otherwise(s["low"]).alias("low"),
            F.when(~done & (u < 0), r).otherwise(s["high"]).alias("high"),
            done.alias("done"),
        )

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(1.0).alias("low"), high.alias("high"), F.lit(False).alias("done")), halve)
    wrong = F.raise_error(F.concat(F.lit("invalid numbers of pairs and of unique pairs: "), pairs.cast("string"), F.lit(", "), unique.cast("string"))).cast("long")
    size = (c * (ends["low"] + ends["high"]) / 2).cast("long")
    return F.when((pairs > 0) & (pairs - unique > 0), F.when((unique <= 0) | (lander_waterman(F.lit(1.0), n, c) < 0), wrong).otherwise(size))


def final_metrics(raw: DataFrame, optical: DataFrame, flow_mode: bool = False) -> DataFrame:
    """The metrics table, by library: pairs instead of their reads, optical pairs, the duplicated share and the library's size."""
    pairs, dups = (F.floor(F.col(c) / 2).cast("long") for c in ("READ_PAIRS_EXAMINED", "READ_PAIR_DUPLICATES"))
    out = raw.withColumn("READ_PAIRS_EXAMINED", pairs).withColumn("READ_PAIR_DUPLICATES", dups).join(optical.select("library", F.col("optical").alias("READ_PAIR_OPTICAL_DUPLICATES")), "library", "left")
    out = out.fillna(0, ["READ_PAIR_OPTICAL_DUPLICATES"])
    examined = F.col("UNPAIRED_READS_EXAMINED") + 2 * F.col("READ_PAIRS_EXAMINED")
    share = F.when(examined > 0, (F.col("UNPAIRED_READ_DUPLICATES") + 2 * F.col("READ_PAIR_DUPLICATES")).cast("double") / examined.cast("double")).otherwise(0.0)
    size = library_size(F.col("READ_PAIRS_EXAMINED") - F.col("READ_PAIR_OPTICAL_DUPLICATES"), F.col("READ_PAIRS_EXAMINED") - F.col("READ_PAIR_DUPLICATES"))
    out = out.withColumn("PERCENT_DUPLICATION", share).withColumn("ESTIMATED_LIBRARY_SIZE", size)
    out = out.withColumn("UNPAIRED_WITH_TLEN", F.lit(0).cast("long")) if flow_mode else out
    return out.select("library", *COUNTS[:5], "READ_PAIR_DUPLICATES", "READ_PAIR_OPTICAL_DUPLICATES", "PERCENT_DUPLICATION", "ESTIMATED_LIBRARY_SIZE", *(["UNPAIRED_WITH_TLEN"] if flow_mode else []))


def roi(size: Column, multiple: Column, pairs: Column, unique: Column) -> Column:
    """How many times the unique pairs come from ``multiple`` times the sequencing."""
    return size * (1 - F.exp(-(multiple * pairs) / size)) / unique


def roi_curve(metrics: DataFrame) -> DataFrame:
    """(library, bin, CoverageMult) for 1 to 100 times the sequencing, of libraries whose size is known."""
    known = metrics.where("ESTIMATED_LIBRARY_SIZE is not null")
    value = roi(F.col("ESTIMATED_LIBRARY_SIZE").cast("double"), F.col("bin"), F.col("READ_PAIRS_EXAMINED").cast("double"), (F.col("READ_PAIRS_EXAMINED") - F.col("READ_PAIR_DUPLICATES")).cast("double"))
    return known.withColumn("_x", F.explode(F.sequence(F.lit(1), F.lit(ROI_POINTS)))).withColumn("bin", F.col("_x").cast("double")).select("library", "bin", value.alias("CoverageMult"))


def set_size_histograms(sets: DataFrame, optical: DataFrame) -> DataFrame:
    """(bin, all_sets, optical_sets, non_optical_sets): how many sets have so many pairs, optical pairs and one, and pairs that are not optical."""
    per = optical.groupBy("rep_idx").agg(F.count(F.lit(1)).alias("_optical"))
    sizes = sets.where("rank = 1").select("rep_idx", "set_size").join(per, "rep_idx", "left").fillna(0, ["_optical"])
    three = F.array(
        F.struct(F.col("set_size").alias("bin"), F.lit(0).alias("kind")),
        F.when(F.col("_optical") > 0, F.struct((F.col("_optical") + 1).alias("bin"), F.lit(1).alias("kind"))),
        F.when(F.col("set_size") > F.col("_optical"), F.struct((F.col("set_size") - F.col("_optical")).alias("bin"), F.lit(2).alias("kind"))),
    )
    cells = sizes.select(F.explode(three).alias("c")).where("c is not null").groupBy(F.col("c.bin").cast("double").alias("bin"))
    return cells.agg(*(F.count_if(F.col("c.kind") == k).cast("double").alias(n) for k, n in enumerate(("all_sets", "optical_sets", "non_optical_sets"))))
