"""SAM text: headers to the driver, records to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..shared import in_input_order

#: The schema of reads: tag values carry their SAM type (``Z:...``), positions are 1-based, tid is the contig's number or -1.
SCHEMA = "idx long, qname string, flag int, tid int, pos long, mapq int, cigar string, mtid int, mpos long, tlen long, seq string, qual string, rg string, tags map<string, string>"


def header(spark: SparkSession, path: str) -> list[str]:
    """The header's lines, in order. It stands before the records, in the first file of a folder, so lines are asked for a few more at a time until one is a record."""
    lines, n = spark.read.text(sorted(spark.read.text(path).inputFiles())[0]), 1000
    while True:
        found = [r.value for r in lines.limit(n).collect()]
        k = next((i for i, x in enumerate(found) if not x.startswith("@")), None)
        if k is not None or len(found) < n:
            return found[:k]
        n *= 8


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a SAM file in file order, numbered by ``idx``; all records count, also those that are never looked at."""
    names = [line.split("\t") for line in header(spark, path) if line.startswith("@SQ")]
    number = {dict(f.split(":", 1) for f in x[1:])["SN"]: i for i, x in enumerate(names)}
    lines = in_input_order(spark.read.text(path).where(~F.col("value").rlike("^@[A-Z][A-Z](\t|$)") & (F.col("value") != "")))
    part = F.split("value", "\t")
    at = F.create_map(*(F.lit(y) for x in number.items() for y in x)) if number else F.expr("cast(map() as map<string, int>)")

    def contig(name: Column) -> Column:
        return F.coalesce(F.try_element_at(at, name), F.lit(-1)).cast("int")

    tags = F.transform(F.slice(part, 12, F.greatest(F.size(part) - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.concat(F.substring(x, 4, 1), F.lit(":"), F.substring(x, 6, 1 << 30)).alias("value")))
    columns = {"qname": part[0], "flag": part[1].cast("int"), "tid": contig(part[2]), "pos": part[3].cast("long"), "mapq": part[4].cast("int"), "cigar": part[5], "mtid": contig(F.when(part[6] == "=", part[2]).otherwise(part[6])), "mpos": part[7].cast("long"), "tlen": part[8].cast("long"), "seq": part[9], "qual": part[10]}
    out = lines.select("idx", *(c.alias(n) for n, c in columns.items()), F.map_from_entries(tags).alias("tags"))
    return out.withColumn("rg", F.substring(F.try_element_at("tags", F.lit("RG")), 3, 1 << 30)).select(*(f.name for f in StructType.fromDDL(SCHEMA)))


def lines(reads: DataFrame, contigs: list[str]) -> DataFrame:
    """(idx, value): each read as a SAM line; tags in the order of their names."""
    names = F.array(*map(F.lit, contigs)) if contigs else F.expr("cast(array() as array<string>)")

    def contig(tid: str) -> Column:
        return F.when(F.col(tid) < 0, "*").otherwise(F.try_element_at(names, F.col(tid) + 1))

    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.expr("cast(map() as map<string, string>)")))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    mate = F.when((F.col("mtid") >= 0) & (F.col("mtid") == F.col("tid")), "=").otherwise(contig("mtid"))
    text = F.concat_ws("\t", "qname", F.col("flag").cast("string"), contig("tid"), F.col("pos").cast("string"), F.coalesce("mapq", F.lit(255)).cast("string"), "cigar", mate, F.col("mpos").cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), "seq", "qual", tags)
    return reads.select("idx", text.alias("value"))


def write(reads: DataFrame, header: list[str], contigs: list[str], path: str) -> None:
    """A folder of text files in input order: the header's lines, then the records; read in the order of the files' names they are one SAM file."""
    spark = reads.sparkSession
    body = lines(reads, contigs)
    head = spark.createDataFrame([(i - len(header), x) for i, x in enumerate(header)], StructType([StructField("idx", LongType()), StructField("value", StringType())]))
    head.unionByName(body).repartitionByRange("idx").sortWithinPartitions("idx").select("value").write.mode("overwrite").text(path)
