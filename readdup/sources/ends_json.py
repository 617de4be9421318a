"""Sorted read ends as JSON arrays, for comparing runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAT = "qname string, score int, read1IndexInFile long, read2IndexInFile long, duplicateSetSize int, libraryId int, orientation int, read1ReferenceIndex int, read1Coordinate int, read2ReferenceIndex int, read2Coordinate int, readGroup int, orientationForOpticalDuplicates int, tile int, x int, y int"


def read(spark: SparkSession, path: str, schema: str = FLAT) -> DataFrame:
    """The records of files that each hold one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write(ends: DataFrame, path: str) -> None:
    """Files that each hold one JSON array of objects, one file a partition; an empty partition has an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = False
        for batch in batches:
            for line in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([("," if some else "[") + line])], names=["value"])
                some = True
        yield pa.RecordBatch.from_arrays([pa.array(["]" if some else "[]"])], names=["value"])

    ends.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)
