"""Tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for shuffle files to go at the end of an execution.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS_OF_PART = (1 << 33) - 1


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see, removed when the driver's Python ends.

    It lies in the cluster's ``spark.checkpoint.dir``. Only in local mode, where driver and executors are one process,
    may that be unset; then it is a temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='readdup-')}"
    path = f"{root.rstrip('/')}/readdup-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by shared_dir() or a table in it; a session that has ended is no error."""
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may be gone when the process ends
        pass


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there: later stages survive lost executors.

    Shuffle files of the write go when it has ended, as nothing else reads them.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, path: str) -> DataFrame:
    """The rows of ``df`` as stored() has them, in as many buckets of ``key`` as shuffles have partitions, so that joins on it move the other side only."""
    spark = df.sparkSession
    name = f"readdup_{uuid.uuid4().hex}"
    atexit.register(forget, spark, name)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.table(name)


def forget(spark: SparkSession, name: str) -> None:
    """Take a table of stored_by() out of the catalogue; its files go with their folder."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may be gone when the process ends
        pass


def counted(numbered: DataFrame, part: str, row: str, name: str) -> DataFrame:
    """Adds ``name``, the number of a row over all parts in turn, from its part and its number in it.

    The driver sees one count a part. The rows must be the same whenever they are read, as those of files are.
    """
    spark = numbered.sparkSession
    base, shift = 0, []
    for r in numbered.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy(part).collect():
        shift.append((r[0], base))
        base += r["n"]
    of = spark.createDataFrame(shift, f"_part {dict(numbered.dtypes)[part]}, _base long")
    return numbered.join(F.broadcast(of), F.col(part) == F.col("_part")).withColumn(name, F.col("_base") + F.col(row)).drop("_part", "_base", part, row)


def in_input_order(rows: DataFrame, name: str = "idx") -> DataFrame:
    """Rows of a file source numbered from 0 in the order of the files' names and of their places in them.

    Spark deals splits to tasks by size, so a row's place is told by its split: the driver sees one count a split.
    """
    spark = rows.sparkSession
    kept = rows.columns
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_m", F.monotonically_increasing_id())
    base, shift = 0, []
    for r in placed.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("first")).orderBy("_file", "_start").collect():
        shift.append((r["_file"], r["_start"], base - r["first"]))
        base += r["n"]
    of = spark.createDataFrame(shift, "_file string, _start long, _shift long")
    return placed.join(F.broadcast(of), ["_file", "_start"]).select(*kept, (F.col("_m") + F.col("_shift")).alias(name))


def in_order(rows: DataFrame, *keys: str, name: str = "idx", path: str | None = None, kept: tuple[str, ...] = ("*",)) -> DataFrame:
    """Rows numbered from 0 in the order of SQL expressions, by ranges that are sorted apart and stored, with the columns ``kept``."""
    ranged = rows.repartitionByRange(*(F.expr(k) for k in keys)).sortWithinPartitions(*(F.expr(k) for k in keys)).withColumn("_m", F.monotonically_increasing_id())
    placed = ranged.select(*map(F.expr, kept), F.shiftright("_m", 33).alias("_split"), F.col("_m").bitwiseAND(F.lit(_ROWS_OF_PART)).alias("_row"))
    return counted(stored(placed, path), "_split", "_row", name)
