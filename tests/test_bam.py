"""BAM round trips, splits, and marking from file to file."""

from __future__ import annotations

import random

import pytest

from readdup.config import Options
from readdup.plans.markdup import run
from readdup.sources import bam, header, sam

HEAD = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:1000000", "@SQ\tSN:chr2\tLN:500", "@RG\tID:A\tLB:L"]


def rows(n):
    rng = random.Random(4)
    for i in range(n):
        size = rng.randint(1, 150)
        tags = {"RG": "Z:A", "NM": f"i:{rng.randint(-3, 70000)}", "XA": "A:q", "XB": "B:c,1,-2,3", "XF": "f:0.5"} if i % 3 else None
        yield (i, f"read{i}", 99, i % 2, 1 + i, i % 61, f"{size}M", i % 2, 5 + i, 0, "".join(rng.choices("ACGTN", k=size)), "".join(chr(33 + rng.randint(0, 60)) for _ in range(size)) if i % 7 else "*", "A" if tags else None, tags)


@pytest.mark.parametrize("split", [1 << 25, 20_000, 3_000])
def test_round_trip(spark, tmp_path, split):
    data = list(rows(3000))
    df = spark.createDataFrame(data, sam.SCHEMA)
    path = str(tmp_path / "x.bam")
    bam.write(df, HEAD, path, single=True)
    assert bam.header(path) == HEAD
    got = bam.read(spark, path, split).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(3000))
    assert [(*r[:-1], r.tags or None) for r in got] == data


def test_empty(spark, tmp_path):
    path = str(tmp_path / "x.bam")
    bam.write(spark.createDataFrame([], sam.SCHEMA), HEAD, path)
    assert bam.read(spark, path).count() == 0


def test_not_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(b"hello" * 100)
    with pytest.raises(ValueError, match="BAM"):
        bam.header(str(tmp_path / "x.bam"))


def test_marking_from_file_to_file(spark, tmp_path):
    pair = lambda n, q: [(n, 99, 0, 100, 60, "4M", 0, 300, 204, "ACGT", q * 4, "A", {"RG": "Z:A"}), (n, 147, 0, 300, 60, "4M", 0, 100, -204, "ACGT", q * 4, "A", {"RG": "Z:A"})]
    reads = sorted(pair("a", "5") + pair("b", "I"), key=lambda r: r[3])
    path, out = str(tmp_path / "in.bam"), str(tmp_path / "out.bam")
    bam.write(spark.createDataFrame([(i, *r) for i, r in enumerate(reads)], sam.SCHEMA), HEAD, path)
    head = bam.header(path)
    done = run(bam.read(spark, path), header.read_groups(spark, head), Options(tagging_policy="all"), header.sort_order(head))
    bam.write(done.output(), head, out)
    assert {(r.qname, r.flag, r.tags.get("DT")) for r in bam.read(spark, out).collect()} == {("a", 99 | 1024, "Z:LB"), ("a", 147 | 1024, "Z:LB"), ("b", 99, None), ("b", 147, None)}


def test_bytes_that_look_like_a_long_record_are_no_start(spark, tmp_path):
    # two bytes before a record of the first contig at 65,536 to 131,071 the size, contig and place of a record of some megabytes can be read
    data = [(i, f"read{i:06d}", 99, 0, 65_600 + i, 60, "50M", 0, 65_700 + i, 0, "ACGTT" * 10, "".join(chr(38 + i * k % 35) for k in range(50)), "A", {"RG": "Z:A"}) for i in range(8000)]
    path = str(tmp_path / "x.bam")
    bam.write(spark.createDataFrame(data, sam.SCHEMA), HEAD, path, single=True)
    got = bam.read(spark, path, 20_000).orderBy("idx").collect()
    assert [tuple(r) for r in got] == data


def test_a_file_that_is_cut_off_is_an_error(spark, tmp_path):
    path, cut = tmp_path / "x.bam", tmp_path / "cut.bam"
    bam.write(spark.createDataFrame(list(rows(3000)), sam.SCHEMA), HEAD, str(path), single=True)
    whole = path.read_bytes()
    ends, at = [], 0
    while at < len(whole):
        at += bam.block_size(whole[at : at + 64])
        ends.append(at)
    cut.write_bytes(whole[: ends[len(ends) // 2]])
    with pytest.raises(Exception, match="not whole"):
        bam.read(spark, str(cut)).count()
