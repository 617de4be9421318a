"""SAM text and headers, the metrics file, JSON of ends."""

from __future__ import annotations

import datetime

import pytest

from readdup.config import Options
from readdup.plans.markdup import run
from readdup.sources import ends_json, header, metrics_file, sam

TEXT = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:chr1\tLN:1000
@SQ\tSN:chr2\tLN:500
@RG\tID:A\tLB:Lib1
@RG\tID:B
@PG\tID:bwa\tPN:bwa
a\t99\tchr1\t100\t60\t10M\t=\t300\t210\tACGTACGTAC\tIIIIIIIIII\tRG:Z:A\tMC:Z:10M
b\t99\tchr1\t100\t60\t10M\t=\t300\t210\tACGTACGTAC\t5555555555\tRG:Z:A\tMC:Z:10M
a\t147\tchr1\t300\t60\t10M\t=\t100\t-210\tACGTACGTAC\tIIIIIIIIII\tRG:Z:A\tMC:Z:10M
b\t147\tchr1\t300\t60\t10M\t=\t100\t-210\tACGTACGTAC\t5555555555\tRG:Z:A\tMC:Z:10M
c\t4\t*\t0\t0\t*\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tRG:Z:B\tNM:i:0
"""


@pytest.fixture
def path(tmp_path):
    (tmp_path / "in.sam").write_text(TEXT)
    return str(tmp_path / "in.sam")


def test_read_mark_write(spark, path, tmp_path):
    head = sam.header(spark, path)
    assert head == TEXT.split("\n")[:6]
    reads, groups = sam.read(spark, path), header.read_groups(spark, head)
    assert [r.idx for r in reads.orderBy("idx").collect()] == [0, 1, 2, 3, 4]
    done = run(reads, groups, Options(tagging_policy="all"), header.sort_order(head))
    out = str(tmp_path / "out")
    names = [n for n, _ in header.contigs(head)]
    sam.write(done.output(), head, names, out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(x for x in lines if x.startswith("@")) == sorted(head)
    marked = [x.split("\t") for x in lines if x.startswith("b\t")]
    assert sorted(int(x[1]) for x in marked) == [99 | 1024, 147 | 1024] and all("DT:Z:LB" in x for x in marked)
    # records that nothing changed come back as they were, but for the order of tags
    before = {tuple(sorted(x.split("\t"))) for x in TEXT.split("\n") if x[:2] in ("a\t", "c\t")}
    assert before <= {tuple(sorted(x.split("\t"))) for x in lines}


def test_folders_are_read_in_the_order_of_names(spark, tmp_path):
    """Spark reads large files first; rows are numbered by name and place all the same."""
    lines, folder = TEXT.split("\n"), tmp_path / "folder.sam"
    folder.mkdir()
    record = lambda i: f"r{i}\t4\t*\t0\t0\t*\t*\t0\t0\t{'A' * (1 + i % 9)}\t*"
    (folder / "part-0").write_text("\n".join([*lines[:6], *map(record, range(3))]) + "\n")
    (folder / "part-1").write_text("\n".join(map(record, range(3, 4000))) + "\n")
    (folder / "part-2").write_text("\n".join(map(record, range(4000, 4100))) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert sam.header(spark, str(folder)) == lines[:6]
        assert [r.qname for r in sam.read(spark, str(folder)).orderBy("idx").collect()] == [f"r{i}" for i in range(4100)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers():
    head = TEXT.split("\n")[:6]
    assert header.sort_order(head) == "coordinate"
    for bad in ([], ["@HD\tVN:1.6"], ["@HD\tVN:1.6\tSO:other"]):
        with pytest.raises(ValueError, match="sort order"):
            header.sort_order(bad)
    out = header.output_header(head, Options(assume_sort_order="queryname", comment=["hi"]), [{"ID": "MD", "PN": "MD"}])
    assert out[0] == "@HD\tVN:1.6\tSO:unknown\tGO:query" and out[-2:] == ["@PG\tID:MD\tPN:MD", "@CO\thi"]


def test_metrics_file(spark, path):
    head = sam.header(spark, path)
    done = run(sam.read(spark, path), header.read_groups(spark, head), Options())
    text = metrics_file.render(done.metrics, done.set_sizes, ["md in.sam"], datetime.datetime(2024, 1, 2, 3, 4, 5))
    lines = text.split("\n")
    assert "# md in.sam" in lines and "# Started on: Tue Jan 02 03:04:05 2024" in lines
    row = dict(zip(lines[lines.index("## METRICS CLASS\treaddup.DuplicationMetrics") + 1].split("\t"), next(x for x in lines if x.startswith("Lib1\t")).split("\t"), strict=True))
    assert row["READ_PAIR_DUPLICATES"] == "1" and row["PERCENT_DUPLICATION"] == "0.5"
    assert "2\t1\t0\t1" in lines


def test_json_of_ends(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"qname": "q", "score": 4482, "read1IndexInFile": 2}, {"qname": "r", "score": 1}]')
    rows = ends_json.read(spark, str(tmp_path / "x.json")).orderBy("qname").collect()
    assert [(r.qname, r.score, r.read1IndexInFile) for r in rows] == [("q", 4482, 2), ("r", 1, None)]
