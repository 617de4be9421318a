"""Runs from file to file, in both orders and formats."""

from __future__ import annotations

import json

import pytest

from readdup import cli
from readdup.config import Options
from readdup.sources import bam, ends_json, sam

HEAD = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:1000000", "@RG\tID:A\tLB:L", "@PG\tID:bwa\tPN:bwa"]


def pair(name, quality, program):
    tags = {"RG": "Z:A"} | ({"PG": f"Z:{program}"} if program else {})
    return [(name, 99, 0, 100, 60, "4M", 0, 300, 204, "ACGT", quality * 4, "A", tags), (name, 147, 0, 300, 60, "4M", 0, 100, -204, "ACGT", quality * 4, "A", tags)]


def rows(order):
    reads = pair("a", "5", "bwa") + pair("b", "I", None) + [("a", 4 + 256, -1, 0, 0, "*", -1, 0, 0, "ACGT", "IIII", "A", {"RG": "Z:A"})]
    reads.sort(key=(lambda r: (r[2] < 0, r[3], r[0])) if order == "coordinate" else (lambda r: (r[0], r[1])))
    return [(i, *r) for i, r in enumerate(reads)]


@pytest.mark.parametrize("order", ["coordinate", "queryname"])
@pytest.mark.parametrize("parts", [False, True])
def test_bam_to_bam(spark, tmp_path, order, parts):
    path, out, metrics = str(tmp_path / "in.bam"), str(tmp_path / "out.bam"), str(tmp_path / "metrics.txt")
    bam.write(spark.createDataFrame(rows(order), sam.SCHEMA), HEAD, path, single=True)
    options = Options(input=[path], output=out, metrics_file=metrics, assume_sort_order=order, tagging_policy="all", comment=["note"])
    counters = cli.mark_file(spark, options, parts, "md in.bam")
    assert counters == {"records": 5, "ends": 4, "pairs": 2, "unmatched": 0, "duplicates": 2, "optical": 0}
    got = bam.read(spark, out).orderBy("idx").collect()
    assert [r.qname for r in got] == [r[1] for r in rows(order)]
    marked = {(r.qname, r.flag & 1024 > 0, r.tags.get("DT"), r.tags["PG"]) for r in got}
    spread = order == "queryname"
    assert marked == {("a", True, "Z:LB", "Z:MarkDuplicates.1"), ("b", False, None, "Z:MarkDuplicates"), ("a", spread, "Z:LB" if spread else None, "Z:MarkDuplicates")}
    head = bam.header(out)
    assert [x for x in head if x.startswith("@PG")] == [HEAD[3], "@PG\tID:MarkDuplicates\tPN:MarkDuplicates\tCL:md in.bam", "@PG\tID:MarkDuplicates.1\tPN:MarkDuplicates\tCL:md in.bam\tPP:bwa"]
    assert head[-1] == "@CO\tnote" and head[0] == (HEAD[0] if order == "coordinate" else "@HD\tVN:1.6\tSO:unknown\tGO:query")
    text = (tmp_path / "metrics.txt").read_text().split("\n")
    assert "# md in.bam" in text and any(x.startswith("bin\tCoverageMult\tall_sets") for x in text)


def test_sam_to_sam_by_command_line(spark, tmp_path):
    lines = [*HEAD, *(r.value for r in sam.lines(spark.createDataFrame(rows("coordinate"), sam.SCHEMA), ["chr1"]).orderBy("idx").collect())]
    (tmp_path / "in.sam").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out.sam")
    assert cli.main(["--input", str(tmp_path / "in.sam"), "--output", out, "--remove-duplicates", "--no-add-pg-tag-to-reads"]) == 0
    assert sorted(r.qname for r in sam.read(spark, out).collect()) == ["a", "b", "b"]
    with pytest.raises(ValueError, match="exactly one"):
        cli.main(["--input", "x.bam", "--input", "y.bam"])


def test_records_at_borders_of_parts(spark, tmp_path):
    df = spark.range(5000).selectExpr("id AS idx", "concat('r', id) AS qname", "0 AS flag", "0 AS tid", "id + 1 AS pos", "60 AS mapq", "'4M' AS cigar", "-1 AS mtid", "0L AS mpos", "0L AS tlen", "'ACGT' AS seq", "'IIII' AS qual", "cast(null AS string) AS rg", "cast(null AS map<string, string>) AS tags")
    path = str(tmp_path / "folder.bam")
    bam.write(df, HEAD, path)
    (tmp_path / "folder.bam" / "notes.txt").write_text("no BAM file")
    assert [r.qname for r in bam.read(spark, path, 4000).orderBy("idx").collect()] == [f"r{i}" for i in range(5000)]


def test_json_arrays(spark, tmp_path):
    path = tmp_path / "ends"
    df = spark.createDataFrame([("q", 5, 2), ("r", 1, None), ("s", 3, 4)], "qname string, score int, read1IndexInFile long")
    ends_json.write(df.repartition(2), str(path))
    assert sum(len(json.loads(f.read_text())) for f in path.glob("part-*")) == 3
    assert sorted((r.qname, r.score, r.read1IndexInFile) for r in ends_json.read(spark, str(path)).collect()) == [("q", 5, 2), ("r", 1, None), ("s", 3, 4)]
