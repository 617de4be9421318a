"""Duplicate sets of single flow reads, whose far ends may be uncertain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Options
from ..functions.flags import REVERSE, has
from ..functions.flow import INSIGNIFICANT, end_coordinate, flow_score
from .duplicate_sets import or_first
from .ends import BARCODES, read_ends, tag_value


def with_flow_order(reads: DataFrame, read_groups: DataFrame) -> DataFrame:
    """Adds flow_order: the read group's own, else that of the first group that has one. ``read_groups`` is the header's."""
    own = F.broadcast(read_groups.select(F.col("rg_id").alias("_rg"), F.col("flow_order").alias("_order")))
    first = read_groups.where("flow_order is not null").orderBy("rg_ordinal").select("flow_order").first()
    return reads.join(own, F.col("rg") == F.col("_rg"), "left").withColumn("flow_order", F.coalesce("_order", F.lit(first[0] if first else None))).drop("_rg", "_order")


def flow_ends(reads: DataFrame, read_groups: DataFrame, options: Options) -> DataFrame:
    """Read ends of single reads with the near end by flow rules in coord, the far one in far (0: insignificant, or not used) and the flow score.

    A read with a mate is an error: pairs have no flow rules.
    """
    ordered = with_flow_order(reads, read_groups)
    forward = ~has(REVERSE)
    order, clipping = F.col("flow_order"), tag_value(reads, "tm")
    far = end_coordinate(~forward, False, order, clipping, options) if options.use_end_in_unpaired_reads else F.lit(INSIGNIFICANT).cast("long")
    extra = ordered.select(F.col("idx").alias("_idx"), end_coordinate(forward, True, order, clipping, options).alias("_near"), far.alias("far"), "flag", "seq", "qual")
    ends = read_ends(reads, read_groups, options).join(extra, F.col("idx") == F.col("_idx"))
    score = flow_score(options.flow_effective_quality_threshold, F.when(F.lit(options.use_end_in_unpaired_reads), F.col("far")).otherwise(F.lit(1))) if options.flow_quality_sum_strategy else F.col("score")
    return ends.withColumn("coord", F.col("_near")).withColumn("score", score).drop("_idx", "_near", "flag", "seq", "qual")


def chained_sets(ends: DataFrame, uncertainty: int, use_barcodes: bool = False) -> DataFrame:
    """The ends with ``chunk``: runs of reads of one place whose far ends follow each other within ``uncertainty``.

    In the order of far ends a read belongs to the set before it if it is at most that far behind the largest one yet.
    Insignificant ends come first and match any, so they belong to the first set.
    """
    key = ["library", "ref", "coord", "reverse", *(BARCODES if use_barcodes else ())]
    order = Window.partitionBy(*key).orderBy("far", or_first("tile"), or_first("x"), or_first("y"), "idx")
    before = F.max(F.when(F.col("far") != INSIGNIFICANT, F.col("far"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("far") != INSIGNIFICANT) & (F.col("far") - before > uncertainty), F.lit(False)).cast("int")
    return ends.withColumn("_fresh", fresh).withColumn("chunk", F.sum("_fresh").over(order)).drop("_fresh")


def flow_duplicates(ends: DataFrame, options: Options) -> DataFrame:
    """(idx) of all but the best read of each chained set; raises if a read has a mate."""
    barcodes = BARCODES if options.use_barcodes else ()
    checked = ends.withColumn("far", F.when(F.col("has_mate"), F.raise_error(F.lit("flow mode has no rules for pairs")).cast("long")).otherwise(F.col("far")))
    best = Window.partitionBy("library", "ref", "coord", "reverse", *barcodes, "chunk").orderBy(F.desc("score"), "far", or_first("tile"), or_first("x"), or_first("y"), "idx")
    return chained_sets(checked, options.unpaired_end_uncertainty, options.use_barcodes).withColumn("_n", F.row_number().over(best)).where("_n > 1").select("idx")
