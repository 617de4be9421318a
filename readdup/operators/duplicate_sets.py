"""Duplicate sets of pairs and of single ends, and which reads of them are duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ends import BARCODES, FR, RF

PLACE = ("library", "ref1", "coord1", "orientation", "ref2", "coord2")


def or_first(name: str) -> Column:
    """Unknown locations stand before known ones."""
    return F.coalesce(name, F.lit(-1))


def pair_sets(pairs: DataFrame, use_barcodes: bool = False) -> DataFrame:
    """Pairs with their set: rep_idx (first end of the best pair, the set's name), set_size, rank (1: kept) and optical_group.

    Best is the highest score, then the smallest location and place in the file. A set with both FR and RF pairs by
    sequencing order falls into two optical groups. All come from one sort by the set's key.
    """
    key = [*PLACE, *(BARCODES if use_barcodes else ())]
    every = Window.partitionBy(*key)
    best = every.orderBy(F.desc("score"), or_first("tile"), or_first("x"), or_first("y"), "idx1", "idx2")
    both = (F.max(F.col("optical_orientation") == FR).over(every)) & (F.max(F.col("optical_orientation") == RF).over(every))
    return pairs.select(
        "*", F.first("idx1").over(best).alias("rep_idx"), F.count(F.lit(1)).over(every).alias("set_size"), F.row_number().over(best).alias("rank"),
        F.when(both, F.col("optical_orientation")).otherwise(0).alias("optical_group"),
    )


def pair_duplicates(sets: DataFrame) -> DataFrame:
    """(idx): both reads of every pair but its set's best."""
    return sets.where("rank > 1").select(F.explode(F.array_distinct(F.array("idx1", "idx2"))).alias("idx"))


def fragment_sets(ends: DataFrame, use_barcodes: bool = False) -> DataFrame:
    """Single ends by library, place and strand: any_mate tells whether a read with a mate is among them, rank orders those without."""
    key = ["library", "ref", "coord", "reverse", *(BARCODES if use_barcodes else ())]
    every = Window.partitionBy(*key)
    best = Window.partitionBy(*key, "has_mate").orderBy(F.desc("score"), or_first("tile"), or_first("x"), or_first("y"), "idx")
    return ends.select("*", F.max("has_mate").over(every).alias("any_mate"), F.row_number().over(best).alias("rank"))


def fragment_duplicates(sets: DataFrame) -> DataFrame:
    """(idx): reads without a mate that share their end with one that has, or with a better one."""
    return sets.where("not has_mate and (any_mate or rank > 1)").select("idx")


def duplicates(pair_sets: DataFrame, fragment_sets: DataFrame) -> DataFrame:
    """(idx): all duplicate reads; those of pairs and of fragments are disjoint."""
    return pair_duplicates(pair_sets).unionByName(fragment_duplicates(fragment_sets))


def representatives(sets: DataFrame) -> DataFrame:
    """(idx, rep_idx, set_size): for all reads of sets of two or more pairs, the best pair's first read and the number of pairs."""
    return sets.where("set_size > 1").select(F.explode(F.array_distinct(F.array("idx1", "idx2"))).alias("idx"), "rep_idx", F.col("set_size").cast("int").alias("set_size"))
