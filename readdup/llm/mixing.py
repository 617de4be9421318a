"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Plan, all DataFrame operations:

1. every document's size in words, once, stored as a narrow table;
2. targets per source: its share of the mix by weight, at most ``most_repeats`` times its size, the excess
   reshared by weight (water-filling: in the order of cap/weight, the sources below the level are full);
3. blocks of ``block_words`` words go to the sources by the highest quotients target / (2 k + 1);
4. each source's blocks go to its shards (seeded hash of doc_id, so a hot source has many) in the same way;
5. in a shard, documents stand in seeded order and the quota is a run of blocks from a seeded place, around
   the end if need be: every document is taken once per full turn and at most two documents are cut by a run.

Highest quotients without a loop: rounding every share of the average divisor differs from the right number of
seats by at most half the parties, so only that many quotients next to the rounding have to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, stored

#: Words of a shard on average, and the most shards a source is cut into; beyond it, shards grow.
SHARD_WORDS, MOST_SHARDS = 1 << 17, 1 << 16


#: Columns that mix() adds, returned or not.
WORKING = ("source_size", "weight", "target", "shard", "taken", "quota", "shards", "_source", "_order", "_shard", "_turns", "_rest", "_from", "_size", "_end", "_begin")


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def highest_quotients(parties: DataFrame, group: list[str], votes: str, seats: str, key: list[str], out: str) -> DataFrame:
    """Adds ``out``: the seats of each party of a group by Sainte-Laguë (ties: ``key`` ascending, nulls last).

    ``votes`` is the party's non-negative number, ``seats`` how many the group gives out, the same in all its rows.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    first = (
        parties.withColumn("_all", F.sum(votes).over(w).cast("double"))
        .withColumn("_r", F.when(F.col("_all") > 0, F.floor(F.col(votes).cast("double") * F.col(seats) / F.col("_all") + 0.5)).otherwise(0).cast("long"))
        .withColumn("_e", F.when(F.col("_all") > 0, F.sum("_r").over(w) - F.col(seats)).otherwise(0))
    )
    # too many were given: the lowest quotients held go back; too few: the highest not held are added
    steps = first.where("_e <> 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.abs("_e"))))
    steps = steps.withColumn("_seat", F.when(F.col("_e") > 0, F.col("_r") - F.col("_k")).otherwise(F.col("_r") + F.col("_k") - 1)).where("_seat >= 0")
    quotient = F.col(votes).cast("double") / (2 * F.col("_seat") + 1)
    # of equal quotients the first key gets its seat first and gives it back last
    near = Window.partitionBy(*(group or [F.lit(0)]))
    back, more = near.orderBy(quotient, *(F.col(c).desc_nulls_first() for c in key)), near.orderBy(-quotient, *(F.col(c).asc_nulls_last() for c in key))
    moved = steps.withColumn("_n", F.when(F.col("_e") > 0, F.row_number().over(back)).otherwise(F.row_number().over(more))).where("_n <= abs(_e)").groupBy(*group, *key).agg(F.sum(F.when(F.col("_e") > 0, -1).otherwise(1)).alias("_moved"))
    moved = moved.select(*[F.col(c).alias(f"_m_{c}") for c in [*group, *key]], "_moved")
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in [*group, *key]]
    return first.join(moved, on=same, how="left").select(*parties.columns, (F.col("_r") + F.coalesce("_moved", F.lit(0))).alias(out))


def targets(sizes: DataFrame, weights: list[int], share: int, most_repeats: int) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size); ``share``: per cent of all sizes that the mix has.

    One row a source, so the ranking over all of them is small.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    one = F.lit(0)
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    fill = Window.partitionBy(one).orderBy((most_repeats * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        named.withColumn("_num", share * F.sum("source_size").over(Window.partitionBy(one)) - 100 * most_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_den", 100 * F.sum("weight").over(after))
        .withColumn("_open", F.col("_num") * F.col("weight") <= F.col("_den") * most_repeats * F.col("source_size"))
    )
    found = Window.partitionBy(one).orderBy(F.col("_open").desc(), (most_repeats * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    level = level.withColumn("_num1", F.first("_num").over(found)).withColumn("_den1", F.first("_den").over(found)).withColumn("_any", F.max("_open").over(Window.partitionBy(one)))
    target = F.when(F.col("_any") & (F.col("_num1") * F.col("weight") <= F.col("_den1") * most_repeats * F.col("source_size")), F.col("weight").cast("double") * F.col("_num1") / F.col("_den1"))
    return level.select("source", "source_size", "weight", F.coalesce(target, (most_repeats * F.col("source_size")).cast("double")).alias("target"))


def mix(sized: DataFrame, weights: list[int] = (5, 2, 1), share: int = 150, most_repeats: int = 2, block_words: int = 16, shard_words: int = SHARD_WORDS, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    ``sized`` has doc_id, source and size (words, long) and is read several times, so give a stored table. Returns
    its columns with source_size, weight, target (its source's, words), shard and taken (long).

    Defined cases: a null source is a source, the last in order; null or empty texts have size 0 and give nothing;
    a null doc_id is hashed as an empty string; repeated rows are documents of their own; an empty table gives none;
    texts of any length are one document; extra columns stay, but those called like a new or a working one are replaced.
    Sources take whole blocks, so a source's words are within one block and its rounding of the target.
    """
    sized = sized.drop(*WORKING)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    by_source = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, most_repeats))
    one = Window.partitionBy(F.lit(0))
    given = by_source.withColumn("_seats", F.round(F.sum("target").over(one) / block_words).cast("long"))
    given = highest_quotients(given, [], "target", "_seats", ["source"], "quota")
    given = given.withColumn("shards", F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / F.lit(shard_words)) + F.lit(1)).cast("long")).drop("_seats")
    given = stored(given)
    placed = (
        sized.withColumn("_order", order)
        .join(given.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("shard", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % F.col("shards"))
    )
    shards = placed.groupBy("source", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shards = highest_quotients(shards, ["source"], "shard_size", "quota", ["shard"], "blocks")
    # a run of whole turns and a rest, from a seeded place
    most = F.least(F.col("blocks") * block_words, F.col("shard_size") * most_repeats)
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    blocks_in = F.ceil(F.col("shard_size") / block_words)
    shards = shards.where("shard_size > 0").select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"),
        F.floor(most / F.col("shard_size")).cast("long").alias("_turns"), (most % F.col("shard_size")).alias("_rest"),
        (start % blocks_in * block_words).cast("long").alias("_from"), F.col("shard_size").alias("_size"),
    )
    row = Window.partitionBy("source", "shard").orderBy("_order", "doc_id", "size")
    at = placed.withColumn("_end", F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_begin", F.col("_end") - F.col("size"))
    at = at.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")), "left")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_end"), high) - F.greatest(F.col("_begin"), low))

    stop = F.col("_from") + F.col("_rest")
    taken = F.col("size") * F.col("_turns") + overlap(F.col("_from"), F.least(stop, F.col("_size"))) + overlap(F.lit(0), stop - F.col("_size"))
    return at.select(*sized.columns, "source_size", "weight", "target", "shard", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the next whole number; those that it takes less than half of go.

    A run of blocks cuts at most two documents of a shard, so rounding moves few words. Of rows with equal doc_id, source and size each is taken as the first.
    """
    sized = stored(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    share = mix(sized).where("size > 0").groupBy("doc_id", "source", "size").agg(F.max(times).alias("_times"))
    share = share.select(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("size").alias("_words"), "_times").where("_times > 0")
    both = docs.withColumn("_size", words_in(F.col("text"))).join(share, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_from")) & (F.col("_size") == F.col("_words")))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, five, two and one parts by source in turn, one and a half times all words."""
    sized = stored(documents(spark, sf_dir).select("doc_id", "source", words_in(F.col("text")).alias("size")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source")
