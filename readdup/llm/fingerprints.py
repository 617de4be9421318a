"""SimHash fingerprints of documents, and search by permuted block tables. DataFrame operations only.

Terms are neighbouring word pairs (a document's last word also stands alone), lower-cased; each votes with the length of
its words, capped, on every bit of its 64-bit hash: for a 1, against a 0. Votes of two bits share one 64-bit sum (its
halves), so a document takes 32 sums. A fingerprint is the 64 majorities as 16 hexadecimal digits; without terms, zeros.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored, words_of

#: Longest pair of words that counts in full; bounds a vote, so that 2^32 / 24 terms fit a sum's half.
MOST_WEIGHT = 24
#: Documents of a range on average, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1024, 10_000
HALVES = 0x0000000100000001


def fingerprints(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(*key, fingerprint long, n_terms long): one row for each distinct ``key``; rows of equal key vote together.

    Null and empty texts, and texts without words, have fingerprint 0. The key's columns are carried by every term, so keep them short.
    """
    words = words_of(F.lower(F.col(text)))
    pairs = texts.select(*key, words.alias("_words")).select(*key, F.explode_outer(F.arrays_zip(F.col("_words").alias("a"), F.slice(F.col("_words"), 2, F.greatest(F.size("_words"), F.lit(1))).alias("b"))).alias("_pair"))
    # explode_outer gives a text without words one null pair, of weight 0
    weighed = pairs.select(
        *key,
        F.xxhash64("_pair.a", "_pair.b").alias("_h"),
        F.when(F.col("_pair.a").isNull(), 0).otherwise(F.least(F.length("_pair.a") + F.coalesce(F.length("_pair.b"), F.lit(0)), F.lit(MOST_WEIGHT))).cast("long").alias("_w"),
    )
    sums = [F.sum(F.shiftrightunsigned(F.col("_h"), b).bitwiseAND(F.lit(HALVES)) * F.col("_w")).alias(f"_s{b}") for b in range(32)]
    votes = weighed.groupBy(*key).agg(F.sum("_w").alias("_all"), F.sum((F.col("_w") > 0).cast("long")).alias("n_terms"), *sums)
    bits: Column = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"_s{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"_s{b}"), 32)
        for at, half in ((b, low), (b + 32, high)):
            bits = bits.bitwiseOR(F.when(half * 2 > F.col("_all"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
    return votes.select(*key, bits.alias("fingerprint"), "n_terms")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bits in which two fingerprints agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def masks(radius: int, more: int) -> list[int]:
    """The bits that each table leads with: all but ``radius`` of radius + ``more`` blocks of the 64 bits, in every choice."""
    blocks = radius + more
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(block, more)]


def block_tables(found: DataFrame, radius: int, more: int) -> DataFrame:
    """The distinct fingerprints of ``found`` in permuted tables: (table, lead, fingerprint), ``lead`` being the bits that the table's order begins with.

    Two fingerprints that differ in at most ``radius`` bits differ in so many of radius + ``more`` blocks at most, so
    they share the lead of a table, which has ``more`` of the blocks: the more, the longer it is and the fewer chance
    meetings there are.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius, more)]
    leads = F.array(*(F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("lead")) for i, m in enumerate(signed)))
    return found.select("fingerprint").distinct().select(F.inline(leads), "fingerprint")


def within(queries: DataFrame, found: DataFrame, radius: int = 3, more: int = 3) -> DataFrame:
    """(query, fingerprint, distance): all fingerprints of ``found`` within ``radius`` bits of one of ``queries``, itself included.

    Both are tables with a column ``fingerprint``; equal ones are searched once, whoever holds them, so a group of
    copies costs no more than one document. Null fingerprints find nothing. By default 20 tables have leads of 31 to 33 bits.
    The join is by sorting, whatever the sizes: tables that grow with the documents never come to the driver to be broadcast.
    """
    left = block_tables(queries.where("fingerprint is not null"), radius, more).withColumnRenamed("fingerprint", "query")
    right = block_tables(found.where("fingerprint is not null"), radius, more)
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    return left.join(right.hint("merge"), ["table", "lead"]).where(distance <= radius).select("query", "fingerprint", distance.alias("distance")).distinct()


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash, copies, next_id, next_text, next_hash) in the order of descending doc_id; after the last comes the first.

    Ranges of doc_id are windows of their own, each with the first row of the next range added, so no window spans the
    table. Null texts are empty, null doc_ids come last, equal doc_ids stand by text_hash (64 bits), and rows with equal
    doc_id and text are one of which ``copies`` tells the number.
    """
    n = docs.select("doc_id").count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts: list[int] = []
    if ranges > 1:  # at most MOST_RANGES numbers
        cuts = sorted({*(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * MOST_RANGES)).first()[0] or [])})
    # ranges count up along the descending order: the largest doc_ids are in 0, nulls behind all
    of = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - rank_among("doc_id", cuts)).cast("int")
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_range", of).withColumn("_hash", F.xxhash64("text"))
    heads = docs.select("doc_id", of.alias("_range")).groupBy("_range").agg(F.max("doc_id").alias("_id"))  # a row a range
    around = Window.partitionBy(F.lit(0)).orderBy("_range")
    heads = heads.withColumn("_to", F.coalesce(F.lag("_range").over(around), F.max("_range").over(Window.partitionBy(F.lit(0)))))
    extra = placed.join(F.broadcast(heads.select("_id", "_to")), F.col("doc_id").eqNullSafe(F.col("_id")))
    extra = extra.groupBy(F.col("_to").alias("_range"), "doc_id").agg(F.min_by("text", "_hash").alias("text"), F.min("_hash").alias("_hash")).withColumn("_extra", F.lit(True))
    both = placed.withColumn("_extra", F.lit(False)).unionByName(extra)
    row = Window.partitionBy("_range").orderBy("_extra", F.col("doc_id").desc_nulls_last(), "_hash")
    same = (F.lag("_hash").over(row) == F.col("_hash")) & F.lag("doc_id").over(row).eqNullSafe(F.col("doc_id")) & (F.lag("_extra").over(row) == F.col("_extra"))
    peers = F.count(F.lit(1)).over(row.rangeBetween(Window.currentRow, Window.currentRow))
    both = both.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("copies", peers).where(~F.col("_same"))
    out = both.select("*", *(F.lead(c).over(row).alias(name) for c, name in (("doc_id", "next_id"), ("text", "next_text"), ("_hash", "next_hash"))))
    return out.where(~F.col("_extra")).select("doc_id", "text", F.col("_hash").alias("text_hash"), "copies", "next_id", "next_text", "next_hash")


def rank_among(column: str, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are less than the column's value, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    values = f"array({','.join(f'{c}L' for c in cuts)})"
    middle = "div(s.low + s.high, 2)"
    return F.expr(
        f"aggregate(sequence(1, {steps}), struct(0 as low, {len(cuts)} as high), (s, i) -> if(s.low >= s.high, s,"
        f" if(element_at({values}, cast({middle} as int) + 1) < {column}, struct(cast({middle} as int) + 1 as low, s.high as high), struct(s.low as low, cast({middle} as int) as high)))).low"
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like the edited and the next ones are.

    The edited text has its last third replaced by as many code points of the next document's beginning.
    """
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    pairs = with_next(documents(spark, sf_dir).select("doc_id", "text")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), cut)))
    none = F.lit(None).cast("long")
    own = F.struct("text", none.alias("next_id"), none.alias("next_hash"), none.alias("copies"), none.alias("n_chars"), F.lit(None).cast("binary").alias("sha"))
    edited = F.struct(F.col("edited").alias("text"), "next_id", "next_hash", "copies", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"))
    key = ["doc_id", "text_hash", "next_id", "next_hash", "copies", "n_chars", "sha"]
    done = stored(fingerprints(pairs.select("doc_id", "text_hash", F.inline(F.array(own, edited))), key))
    plain = done.where("sha is null")
    a = done.where("sha is not null").select(*key, F.col("fingerprint").alias("_edited"))
    b = plain.select(F.col("doc_id").alias("_b"), F.col("text_hash").alias("_bh"), F.col("fingerprint").alias("_own"))
    c = plain.select(F.col("doc_id").alias("_c"), F.col("text_hash").alias("_ch"), F.col("fingerprint").alias("_next"))
    all3 = a.join(b, F.col("doc_id").eqNullSafe(F.col("_b")) & (F.col("text_hash") == F.col("_bh"))).join(c, F.col("next_id").eqNullSafe(F.col("_c")) & (F.col("next_hash") == F.col("_ch")))
    all3 = all3.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    shown = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return all3.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), shown("_own").alias("fingerprint"), shown("_edited").alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_documents, n_near): for each document whose id is divisible by 20 how many other documents have a fingerprint within 3 bits of its own, and how many such fingerprints there are besides it.

    Documents without words have no neighbours. Repeated rows are documents of their own.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    of_text = stored(fingerprints(docs.groupBy("hash").agg(F.first("text").alias("text")), ["hash"]).where("n_terms > 0"))
    marked = docs.select("doc_id", "hash").join(of_text.select("hash", "fingerprint").hint("merge"), "hash", "left")
    counts = marked.where("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    asked = marked.where("doc_id % 20 = 0")
    met = within(asked, of_text).join(counts.hint("merge"), "fingerprint").groupBy("query").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("prints"))
    out = asked.join(met.hint("merge"), F.col("fingerprint") == F.col("query"), "left")
    return out.select("doc_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_documents"), F.coalesce(F.col("prints") - 1, F.lit(0)).alias("n_near"))
