"""Connected components of an edge table, by alternating large-star and small-star steps; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_dir, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of ``edges`` (a, b: long); loops and repeated edges are allowed.

    Nodes only in no edge have no row. Each round is written to the shared folder, so the plan stays short.
    """
    spark = edges.sparkSession
    path = shared_dir(spark)
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}/0")
    seen, step = None, 0
    while True:
        # large star: every larger neighbour of u goes to the least around u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        after = stored(small, f"{path}/{step}")
        state = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        remove(spark, f"{path}/{step - 1}")
        now = after
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
