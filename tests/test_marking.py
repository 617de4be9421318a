"""Hand-made reads: ties, strands, fragments, libraries, quality checks, clusters, barcodes, and the order of input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from readdup.config import Options
from readdup.operators import flow_sets
from readdup.operators.metrics import library_size
from readdup.plans.markdup import MarkDuplicates, run
from readdup.sources import sam

GROUPS = [("A", 0, "Lib1", "TGCA"), ("B", 1, "Lib2", None)]


def read(name, flag, tid, pos, score=40, rg="A", cigar="10M", mtid=-1, mpos=0, **tags):
    return {"qname": name, "flag": flag, "tid": tid, "pos": pos, "mapq": 60, "cigar": cigar, "mtid": mtid, "mpos": mpos, "tlen": 0, "seq": "ACGTACGTAC", "qual": chr(33 + score) * 10, "rg": rg, "tags": {k: f"Z:{v}" for k, v in tags.items()}}


def pair(name, pos1, pos2, score=40, tid=0, rg="A", rf=False, qc=0, **tags):
    """A pair at two forward/reverse places; with rf the reverse read is the first one sequenced."""
    one, two = (128, 64) if rf else (64, 128)
    return [read(name, 1 + 32 + one + qc, tid, pos1, score, rg, mtid=tid, mpos=pos2, **tags), read(name, 1 + 16 + two + qc, tid, pos2, score, rg, mtid=tid, mpos=pos1, **tags)]


def frame(spark, reads):
    rows = sorted(reads, key=lambda r: (r["tid"] < 0, r["tid"], r["pos"], r["qname"]))
    return spark.createDataFrame([{"idx": i} | r for i, r in enumerate(rows)], sam.SCHEMA)


def job(spark, reads, **options):
    groups = spark.createDataFrame(GROUPS, "rg_id string, rg_ordinal int, library string, flow_order string")
    return MarkDuplicates(frame(spark, reads), groups, Options(**options))


def names(df, of="qname"):
    return sorted(r[of] for r in df.collect())


def duplicates(spark, reads, **options):
    return names(job(spark, reads, **options).marked.where("is_duplicate"))


def test_lower_score_is_marked(spark):
    assert duplicates(spark, pair("a", 100, 300, 30) + pair("b", 100, 300, 40)) == ["a", "a"]


def test_ties_go_by_location(spark):
    assert duplicates(spark, pair("r:1:1101:900:5", 100, 300) + pair("r:1:1101:100:5", 100, 300)) == ["r:1:1101:900:5"] * 2


def test_quality_check_loses(spark):
    assert duplicates(spark, pair("a", 100, 300, 60, qc=512) + pair("b", 100, 300, 20)) == ["a", "a"]


def test_libraries_are_apart(spark):
    assert duplicates(spark, pair("a", 100, 300) + pair("b", 100, 300, rg="B")) == []
    assert duplicates(spark, pair("a", 100, 300, rg=None) + pair("b", 100, 300, 20, rg="none")) == ["b", "b"]


def test_fragments(spark):
    single = lambda n, s: read(n, 0, 0, 100, s)
    assert duplicates(spark, [single("x", 30), single("y", 40), single("z", 20)]) == ["x", "z"]
    assert duplicates(spark, pair("p", 100, 300, 20) + [single("x", 90)]) == ["x"]
    # the mate never comes: still better than a single read, never marked
    assert duplicates(spark, pair("p", 100, 300, 20)[:1] + [single("x", 90)]) == ["x"]


def test_unmapped_mate(spark):
    half = lambda n, s: [read(n, 1 + 8 + 64, 0, 100, s), read(n, 1 + 4 + 128, 0, 100, s, cigar="*")]
    assert duplicates(spark, half("a", 30) + half("b", 40)) == ["a"]


def test_opposite_ends_at_one_place_are_one_set(spark):
    # the reverse read's unclipped end is its 5' end: both ends at 109
    reads = [read("a", 1 + 32 + 64, 0, 109, mtid=0, mpos=100), read("a", 1 + 16 + 128, 0, 100, mtid=0, mpos=109), read("b", 1 + 16 + 64, 0, 100, 30, mtid=0, mpos=109), read("b", 1 + 32 + 128, 0, 109, 30, mtid=0, mpos=100)]
    done = job(spark, reads)
    assert {r.orientation for r in done.pairs.collect()} == {3}
    assert names(done.marked.where("is_duplicate")) == ["b", "b"]


def test_clipping_is_undone(spark):
    one = [read("a", 1 + 32 + 64, 0, 103, cigar="3S7M", mtid=0, mpos=300), read("a", 1 + 16 + 128, 0, 300, cigar="6M4S", mtid=0, mpos=103)]
    assert duplicates(spark, one + pair("b", 100, 300, 20)) == ["b", "b"]


def test_old_flags_go_and_secondary_reads_follow_the_name_only(spark):
    reads = pair("a", 100, 300, 30) + pair("b", 100, 300, 40) + [read("a", 1 + 64 + 256, 1, 50), read("z", 1024, 2, 5)]
    groups = spark.createDataFrame(GROUPS, "rg_id string, rg_ordinal int, library string, flow_order string")
    by_place = run(frame(spark, reads), groups, Options())
    assert by_place.marked.where("(flag & 1024) <> 0").count() == 2
    by_name = run(frame(spark, reads), groups, Options(assume_sort_order="queryname"))
    assert names(by_name.marked.where("(flag & 1024) <> 0")) == ["a"] * 3


def test_optical_chain(spark):
    at = lambda n, x, s: pair(f"r:1:1101:{x}:10", 100, 300, s)
    done = job(spark, at("a", 0, 40) + at("b", 90, 30) + at("c", 180, 20) + at("d", 900, 10), tagging_policy="all")
    assert done.optical.count() == 2
    tags = {r.qname: r.tags.get("DT") for r in done.output().collect()}
    assert tags == {"r:1:1101:0:10": None, "r:1:1101:90:10": "Z:SQ", "r:1:1101:180:10": "Z:SQ", "r:1:1101:900:10": "Z:LB"}
    assert names(job(spark, at("a", 0, 40) + at("b", 90, 30) + at("d", 900, 10), remove_sequencing_duplicates=True).output()) == ["r:1:1101:0:10"] * 2 + ["r:1:1101:900:10"] * 2


def test_optical_groups_by_strand(spark):
    reads = pair("r:1:1101:0:10", 100, 300, 40) + pair("r:1:1101:50:10", 100, 300, 30, rf=True)
    assert job(spark, reads).optical.count() == 0
    sizes = {r.bin: (r.all_sets, r.optical_sets, r.non_optical_sets) for r in job(spark, reads).set_sizes.collect()}
    assert sizes == {2.0: (1.0, 0.0, 1.0)}


def test_barcodes(spark):
    reads = pair("a", 100, 300, 40, BX="one") + pair("b", 100, 300, 30, BX="two") + pair("c", 100, 300, 20, BX="one")
    assert duplicates(spark, reads, barcode_tag="BX") == ["c", "c"]
    assert duplicates(spark, reads) == ["b", "b", "c", "c"]


def test_duplex_umis_meet(spark):
    top = pair("a", 100, 300, 40, RX="AT-GA", MC="10M")
    bottom = pair("b", 100, 300, 30, rf=True, RX="GA-AT", MC="10M")
    assert duplicates(spark, top + bottom, barcode_tag="RX", duplex_umi=True) == ["b", "b"]
    assert duplicates(spark, top + bottom, barcode_tag="RX") == []


def test_set_members(spark):
    done = job(spark, pair("a", 100, 300, 30) + pair("b", 100, 300, 40) + pair("c", 500, 700), tag_duplicate_set_members=True).output()
    assert {(r.qname, r.tags.get("DS")) for r in done.collect()} == {("a", "i:2"), ("b", "i:2"), ("c", None)}
    assert len({r.tags["DI"] for r in done.collect() if r.qname != "c"}) == 1


def test_metrics_of_one_library(spark):
    done = job(spark, pair("a", 100, 300, 30) + pair("b", 100, 300, 40) + pair("c", 500, 700) + [read("x", 0, 1, 5), read("u", 4, -1, 0, cigar="*"), read("a", 1 + 256, 0, 5)])
    (row,) = done.metrics.collect()
    assert (row.UNPAIRED_READS_EXAMINED, row.READ_PAIRS_EXAMINED, row.UNMAPPED_READS, row.SECONDARY_OR_SUPPLEMENTARY_RDS, row.READ_PAIR_DUPLICATES) == (1, 3, 1, 1, 1)
    assert row.PERCENT_DUPLICATION == pytest.approx(2 / 7)
    assert done.roi().count() == 100


def test_library_sizes(spark):
    import math

    def size(n, c):
        f = lambda r: c / (r * c) - 1 + math.exp(-n / (r * c))
        low, high = 1.0, 100.0
        while f(high) > 0:
            high *= 10
        for _ in range(40):
            r = (low + high) / 2
            u = f(r)
            if u == 0:
                break
            low, high = (r, high) if u > 0 else (low, r)
        return int(c * (low + high) / 2)

    cases = [(n, c) for n in (2, 10, 1000, 123456) for c in (1, n // 2, n - 1) if 0 < c < n]
    df = spark.createDataFrame(cases, "n long, c long").select("n", "c", library_size(F.col("n"), F.col("c")).alias("s"))
    assert {(r.n, r.c): r.s for r in df.collect()} == {x: size(*x) for x in cases}
    assert spark.createDataFrame([(5, 5)], "n long, c long").select(library_size(F.col("n"), F.col("c")).alias("s")).first().s is None


def test_input_order_does_not_matter(spark):
    reads = pair("a", 100, 300, 30) + pair("b", 100, 300, 40) + pair("c", 100, 300, 40) + [read("x", 0, 0, 100)]
    one = job(spark, reads)
    other = MarkDuplicates(one.reads.orderBy(F.rand(3)), one.read_groups, one.options)
    assert sorted(one.marked.select("idx", "flag").collect()) == sorted(other.marked.select("idx", "flag").collect())


def test_empty_input(spark):
    done = job(spark, [read("x", 4, -1, 0, cigar="*")])
    assert done.duplicates.count() == 0 and done.optical.count() == 0 and done.metrics.count() == 1


def test_flow_reads(spark):
    reads = [read(n, 0, 0, 100, s, cigar=c) for n, s, c in (("a", 40, "10M"), ("b", 30, "10M1I1M"), ("c", 20, "10M90D10M"))]
    loose = job(spark, reads, flow_mode=True)
    assert names(loose.marked.where("is_duplicate")) == ["b", "c"]
    exact = job(spark, reads, flow_mode=True, use_end_in_unpaired_reads=True)
    assert names(exact.marked.where("is_duplicate")) == []
    near = job(spark, reads, flow_mode=True, use_end_in_unpaired_reads=True, unpaired_end_uncertainty=2)
    assert names(near.marked.where("is_duplicate")) == ["b"]
    with pytest.raises(Exception, match="pairs"):
        flow_sets.flow_duplicates(job(spark, pair("p", 1, 50), flow_mode=True).ends, Options(flow_mode=True)).collect()


def test_options():
    with pytest.raises(ValueError, match="uncertainty"):
        Options(unpaired_end_uncertainty=3)
    with pytest.raises(ValueError, match="exactly one"):
        Options(input=["a", "b"]).only_input()
    with pytest.raises(ValueError, match="sorted"):
        Options().sort_order("unsorted")
    assert Options(assume_sorted=True).sort_order("unsorted") == "coordinate"
