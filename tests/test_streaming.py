from __future__ import annotations

from readdup.sources import fixture
from readdup.streaming.counts import library_counts


def test_stream_counts_as_the_table_does(spark, tmp_path):
    reads = fixture.reads(spark, "/root/testdata/sf0.001").select("idx", "flag", "rg")
    path = str(tmp_path / "reads")
    reads.repartition(3).write.parquet(path)
    groups = fixture.read_groups(spark)
    stream = library_counts(spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(path), groups)
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(spark.table("counts").collect()) == sorted(library_counts(reads, groups).collect())
