"""Ends and scores of flow-sequenced reads, whose errors are in the lengths of homopolymers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Options
from .cigar import reference_length, unclipped_end, unclipped_start
from .flags import QC_FAIL, REVERSE, has
from .scoring import FAILED, MOST

#: An end whose place says nothing, and the score of a read that has one.
INSIGNIFICANT, NO_SCORE = 0, -1


def walked_bases(seq: Column, order: Column, from_start: Column, skip: Column) -> Column:
    """How many bases the first ``skip`` flows read, from one end inwards.

    Flow number f is of base ``order[f mod n]``, and each homopolymer is read in the next flow of its base, so its flow
    is the first one's plus the distances in the order from homopolymer to homopolymer. The bases before the first
    homopolymer behind the skipped flows count, the first homopolymer always, and none behind a base that the order
    lacks. A text without bases or an empty order has none, and a first base that the order lacks counts alone.
    """
    bases = F.when(from_start, F.split(seq, "")).otherwise(F.reverse(F.split(seq, "")))
    n = F.length(order)
    start = F.struct(F.lit("").alias("base"), F.lit(-1).alias("place"), F.lit(0).alias("flow"), F.lit(0).alias("count"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        place = F.position(x, order) - 1
        first, same = s["count"] == 0, s["base"] == x
        flow = F.when(first, place).when(same, s["flow"]).otherwise(s["flow"] + F.pmod(place - s["place"], n))
        over = s["over"] | (~first & ~same & ((place < 0) | (flow >= skip)))
        return F.struct(x.alias("base"), place.alias("place"), flow.alias("flow"), (s["count"] + F.when(over, 0).otherwise(1)).alias("count"), (over | (first & (place < 0))).alias("over"))

    found = F.aggregate(bases, start, step)["count"]
    return F.when((F.length(seq) > 0) & (n > 0), found).otherwise(0).cast("int")


def end_coordinate(start_end: Column, certain: bool, order: Column, clipping: Column, options: Options) -> Column:
    """Where the read ends on its start side (``start_end``) or the other one, from pos, cigar and seq; 0 is insignificant.

    Without flow order it is the unclipped end. Otherwise, in this order: the aligned end if clipped ends are to be used
    (for uncertain ends by use_end_in_unpaired_reads); behind the skipped flows, for a certain end; the unclipped end if
    the ``tm`` tag tells that the end is known (A; with flow_q_is_known_end also Q); insignificant if it is uncertain
    and the tag has Q or Z; else the unclipped end.
    """
    pos, cigar = F.col("pos"), F.col("cigar")
    unclipped = F.when(start_end, unclipped_start(pos, cigar)).otherwise(unclipped_end(pos, cigar)).cast("long")
    aligned = F.when(start_end, pos).otherwise(pos + reference_length(cigar) - 1).cast("long")
    marks = F.coalesce(clipping, F.lit(""))
    known = marks.rlike("[AQ]" if options.flow_q_is_known_end else "A")
    if options.use_unpaired_clipped_end:
        return F.when(order.isNull(), unclipped).otherwise(aligned)
    if certain and options.flow_skip_first_n_flows:
        bases = walked_bases(F.col("seq"), order, start_end, F.lit(options.flow_skip_first_n_flows))
        return F.when(order.isNull(), unclipped).otherwise(unclipped + F.when(start_end, bases).otherwise(-bases))
    if certain:
        return unclipped
    return F.when(order.isNotNull() & ~known & marks.rlike("[QZ]"), F.lit(INSIGNIFICANT).cast("long")).otherwise(unclipped)


def flow_score(threshold: int, end: Column) -> Column:
    """Sum over bases of the quality that their homopolymer began with, where it reaches the threshold; -1 for an insignificant end.

    The beginning is by sequencing, so from the right on the reverse strand. Every base counts once; the sum is 16383
    at most, and a failed quality check costs 16384.
    """
    qualities = F.transform(F.split(F.col("qual"), ""), lambda c: F.ascii(c) - 33)
    cells = F.arrays_zip(F.split(F.col("seq"), "").alias("b"), qualities.alias("q"))
    cells = F.when(has(REVERSE), F.reverse(cells)).otherwise(cells)
    step = F.aggregate(
        cells,
        F.struct(F.lit("").alias("base"), F.lit(0).alias("quality"), F.lit(0).alias("sum")),
        lambda s, x: F.struct(
            x["b"].alias("base"),
            F.when(x["b"] == s["base"], s["quality"]).otherwise(x["q"]).alias("quality"),
            (s["sum"] + F.when(F.when(x["b"] == s["base"], s["quality"]).otherwise(x["q"]) >= threshold, F.when(x["b"] == s["base"], s["quality"]).otherwise(x["q"])).otherwise(0)).alias("sum"),
        ),
    )
    return F.when(end == INSIGNIFICANT, NO_SCORE).otherwise(F.least(step["sum"], F.lit(MOST)) - F.when(has(QC_FAIL), FAILED).otherwise(0)).cast("int")
