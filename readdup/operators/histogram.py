"""Histograms as tables of (bin, value): the number of observations, or any weight, of each bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(values: DataFrame, bin_: Column, amount: Column | None = None) -> DataFrame:
    """(bin, value) of a column's values, each counting ``amount`` (1)."""
    return values.groupBy(bin_.cast("double").alias("bin")).agg(F.sum(amount if amount is not None else F.lit(1.0)).cast("double").alias("value"))


def prefilled(found: DataFrame, bins: list[float]) -> DataFrame:
    """With all ``bins``, at 0 where nothing was counted."""
    empty = found.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, map(float, bins)))).alias("bin"), F.lit(0.0).alias("value")) if bins else found.limit(0)
    return found.unionByName(empty).groupBy("bin").agg(F.sum("value").alias("value"))


def statistics(found: DataFrame) -> DataFrame:
    """One row: size (bins), sum (of bin times value), sum_of_values, mean, standard_deviation (n - 1), mean_bin_size and median_bin_size."""
    total = found.agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.col("bin") * F.col("value")).alias("sum"), F.sum("value").alias("sum_of_values"),
        F.sum(F.col("bin") * F.col("bin") * F.col("value")).alias("_squares"), F.avg("value").alias("mean_bin_size"), F.percentile("value", 0.5).alias("median_bin_size"),
    )
    mean = F.col("sum") / F.col("sum_of_values")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") - F.col("sum_of_values") * mean * mean) / (F.col("sum_of_values") - 1))
    return total.select("size", "sum", "sum_of_values", F.when(F.col("sum_of_values") > 0, mean).alias("mean"), F.when(F.col("sum_of_values") > 1, spread).alias("standard_deviation"), "mean_bin_size", "median_bin_size")
