"""Flags and tags on the reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALL, DONT_TAG, QUERYNAME, Options
from ..functions.flags import DUPLICATE, is_candidate
from ..functions.umi import molecular_identifier, template_strand
from .ends import tag_value

LIBRARY, SEQUENCING = "LB", "SQ"


def marked(reads: DataFrame, duplicates: DataFrame, optical: DataFrame | None, order: str = "coordinate") -> DataFrame:
    """The reads with is_duplicate and is_optical, and the flag's duplicate bit set or cleared to match.

    Without ``optical`` nobody asks for is_optical, and it is false.

    In coordinate order the reads themselves are marked. In queryname order the mark spreads to every record of the
    name: secondary, supplementary and unmapped ones.
    """
    ids = duplicates.select("idx", F.lit(True).alias("_dup"))
    ids = ids.withColumn("_opt", F.lit(None).cast("boolean")) if optical is None else ids.join(optical.select("idx", F.lit(True).alias("_opt")), "idx", "left")
    out = reads.join(ids, "idx", "left")
    if order == QUERYNAME:
        name = Window.partitionBy("qname")
        out = out.withColumn("_dup", F.max("_dup").over(name)).withColumn("_opt", F.max("_opt").over(name))
    out = out.withColumn("is_duplicate", F.coalesce("_dup", F.lit(False))).withColumn("is_optical", F.coalesce("_opt", F.lit(False))).drop("_dup", "_opt")
    flag = F.when(F.col("is_duplicate"), F.col("flag").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("flag").bitwiseAND(F.lit(~DUPLICATE)))
    return out.withColumn("flag", flag.cast("int"))


def duplicate_type(policy: str) -> Column:
    """The DT tag's value: SQ for optical duplicates, and LB for others where all are to be tagged; else null."""
    if policy == DONT_TAG:
        return F.lit(None).cast("string")
    return F.when(F.col("is_optical"), SEQUENCING).when(F.col("is_duplicate") & F.lit(policy == ALL), LIBRARY)


def with_set_members(reads: DataFrame, representatives: DataFrame, order: str = "coordinate") -> DataFrame:
    """Adds DI (the set's first read) and DS (its number of pairs) to mapped primary reads; in queryname order by name."""
    rep = representatives.select("idx", F.col("rep_idx").alias("di"), F.col("set_size").alias("ds"))
    out = reads.join(rep, "idx", "left")
    if order == QUERYNAME:
        name = Window.partitionBy("qname")
        out = out.withColumn("di", F.max("di").over(name)).withColumn("ds", F.max("ds").over(name))
    return out.withColumn("di", F.when(is_candidate(), F.col("di"))).withColumn("ds", F.when(is_candidate(), F.col("ds")))


def put_tag(tags: Column, name: str, value: Column, kind: str = "Z") -> Column:
    """The tag map with one tag set anew; a null value leaves it without that tag."""
    rest = F.map_filter(tags, lambda k, _: k != name)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), F.concat(F.lit(f"{kind}:"), value.cast("string")))))


def tagged(reads: DataFrame, options: Options, contigs: Column | None = None) -> DataFrame:
    """Writes DT, DI, DS and the molecular identifier into the tag map, as the options ask; older values of DT go if they are to be cleared."""
    tags = F.coalesce(F.col("tags"), F.expr("cast(map() as map<string, string>)"))
    kind = duplicate_type(options.tagging_policy)
    if options.clear_dt:
        tags = put_tag(tags, "DT", kind)
    elif options.tagging_policy != DONT_TAG:
        tags = F.when(kind.isNotNull(), put_tag(tags, "DT", kind)).otherwise(tags)
    if options.tag_duplicate_set_members:
        for name, column in (("DI", "di"), ("DS", "ds")):
            tags = F.when(F.col(column).isNotNull(), put_tag(tags, name, F.col(column), "i")).otherwise(tags)
    if options.barcode_tag and options.molecular_identifier_tag:
        contig = contigs if contigs is not None else F.col("tid").cast("string")
        value = molecular_identifier(contig, template_strand(tag_value(reads, "MC")), options.duplex_umi)
        tags = F.when(is_candidate(), put_tag(tags, options.molecular_identifier_tag, value)).otherwise(tags)
    return reads.withColumn("tags", tags)


def kept(reads: DataFrame, options: Options) -> DataFrame:
    """Without the duplicates that the options remove."""
    if options.remove_duplicates:
        return reads.where(~F.col("is_duplicate"))
    if options.remove_sequencing_duplicates:
        return reads.where(~F.col("is_optical"))
    return reads
