"""Joining mates to pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ends import FR, RF, orientation


def mates(ends: DataFrame) -> DataFrame:
    """(rg, qname, a, b, n): reads with mates by read group and name, two by two in file order; n is 1 where one is left over.

    One shuffle: the aggregation is on the window's key.
    """
    row = Window.partitionBy("rg", "qname").orderBy("idx")
    body = F.struct("idx", "library", "rg_ordinal", "ref", "coord", "reverse", "score", "mate_ref", "first", "tile", "x", "y", "barcode", "read_one_barcode", "read_two_barcode")
    two = ends.where("has_mate").withColumn("_pair", F.floor((F.row_number().over(row) - 1) / 2)).withColumn("_end", body)
    return two.groupBy("rg", "qname", "_pair").agg(F.min_by("_end", "idx").alias("a"), F.max_by("_end", "idx").alias("b"), F.count(F.lit(1)).alias("n")).drop("_pair")


def join_mates(ends: DataFrame) -> DataFrame:
    """Both ends of each pair, the one earlier in the file as ``a``; mates must expect each other on their contigs."""
    return mates(ends).where("n = 2 and a.mate_ref = b.ref and b.mate_ref = a.ref")


def unmatched(ends: DataFrame) -> DataFrame:
    """(rg, qname, idx) of reads whose mate never came."""
    return mates(ends).where("n = 1 or a.mate_ref <> b.ref or b.mate_ref <> a.ref").select("rg", "qname", F.explode(F.when(F.col("n") == 1, F.array("a.idx")).otherwise(F.array("a.idx", "b.idx"))).alias("idx"))


def pairs(ends: DataFrame) -> DataFrame:
    """One row a pair in canonical form: the end with the smaller (ref, coord) is the first, the earlier read on a tie.

    ``orientation`` goes by position, and two opposite ends at one place are always FR; ``optical_orientation`` goes by
    the order of sequencing. The score is the sum of both.
    """
    joined = join_mates(ends)
    keep = (F.col("b.ref") > F.col("a.ref")) | ((F.col("b.ref") == F.col("a.ref")) & (F.col("b.coord") >= F.col("a.coord")))
    ordered = joined.select("qname", "rg", F.when(keep, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(keep, F.col("b")).otherwise(F.col("a")).alias("q"), "a", "b")
    strands = orientation(F.col("p.reverse"), F.col("q.reverse"))
    same = (F.col("p.ref") == F.col("q.ref")) & (F.col("p.coord") == F.col("q.coord"))
    # the later read's flag tells which of the two was sequenced first
    optical = F.when(F.col("b.first"), orientation(F.col("b.reverse"), F.col("a.reverse"))).otherwise(orientation(F.col("a.reverse"), F.col("b.reverse")))
    return ordered.select(
        F.col("p.idx").alias("idx1"), F.col("q.idx").alias("idx2"), F.col("a.library").alias("library"), F.col("a.rg_ordinal").alias("rg_ordinal"),
        F.col("p.ref").alias("ref1"), F.col("p.coord").alias("coord1"), F.col("q.ref").alias("ref2"), F.col("q.coord").alias("coord2"),
        F.when(same & (strands == RF), FR).otherwise(strands).cast("int").alias("orientation"), optical.cast("int").alias("optical_orientation"),
        (F.col("a.score") + F.col("b.score")).alias("score"), F.col("a.tile").alias("tile"), F.col("a.x").alias("x"), F.col("a.y").alias("y"),
        F.col("a.barcode").alias("barcode"),
        F.coalesce("a.read_one_barcode", "b.read_one_barcode").alias("read_one_barcode"), F.coalesce("a.read_two_barcode", "b.read_two_barcode").alias("read_two_barcode"),
    )
