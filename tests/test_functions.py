"""Names, CIGARs, scores, UMIs, union-find, program ids: small cases with known answers."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from readdup.functions import cigar, flow, names, scoring, umi
from readdup.operators import optical
from readdup.operators.optical import union_find
from readdup.operators.program_groups import ProgramIds, base36, chain
from readdup.plans.queries import NAME_PATTERN


def ascii_number(text):
    """The number that a text begins with, by the book: an optional minus, then digits; None without digits."""
    sign, digits = (-1, text[1:]) if text[:1] == "-" else (1, text)
    n = next((i for i, c in enumerate(digits) if c not in "0123456789"), len(digits))
    return sign * int(digits[:n]) if n else None


@pytest.mark.parametrize("default", [True, False])
def test_locations(spark, default):
    rng = random.Random(3)
    rows = []
    for fields in (1, 2, 3, 4, 5, 6, 7, 8):
        for _ in range(12):
            parts = ["".join(rng.choices("ABCXYZ0123456789-", k=rng.randint(1, 6))) for _ in range(fields)]
            ends = [rng.randrange(1, 60_000) for _ in range(3)]
            located = fields in (5, 7) if default else fields >= 3
            if fields >= 3:
                parts[-3:] = map(str, ends)
            rows.append((":".join(parts), *(ends if located else [None] * 3)))
    rows.append(("", None, None, None))
    df = spark.createDataFrame(rows, "n string, t int, x int, y int")
    got = df.select("*", *(c.alias(f"g_{k}") for k, c in names.location(F.col("n"), "default" if default else NAME_PATTERN).items())).collect()
    assert [r.n for r in got if tuple(r[1:4]) != tuple(r[4:7])] == []
    assert df.select(*(c.alias(k) for k, c in names.location(F.col("n"), "").items())).distinct().collect() == [(None, None, None)]


def test_integer_prefixes(spark):
    rng = random.Random(4)
    texts = ["", "-", "7", "-7"] + ["".join(rng.choices("-0123456789xyz. ", weights=[2] + [3] * 10 + [1] * 5, k=rng.randint(1, 8))) for _ in range(600)]
    got = spark.createDataFrame([(t, ascii_number(t)) for t in texts], "t string, n int").select("t", names.rapid_parse_int(F.col("t")).alias("g"), "n").where("not (g <=> n)")
    assert got.collect() == []


def test_cigars(spark):
    rows = [("5H3S40M2D5M4S1H", 100, 92, 151), ("50M", 1, 1, 50), ("10M5N10M", 10, 10, 34), ("3S4=1X2I4M", 7, 4, 15)]
    df = spark.createDataFrame(rows, "c string, p int, s int, e int")
    assert df.where((cigar.unclipped_start(F.col("p"), F.col("c")) != F.col("s")) | (cigar.unclipped_end(F.col("p"), F.col("c")) != F.col("e"))).count() == 0


def test_scores(spark):
    q = lambda *xs: "".join(chr(33 + x) for x in xs)
    rows = [(q(14, 15, 40), 0, 55), (q(*[90] * 200), 0, 16383), (q(20), 512, 20 - 16384), ("*", 0, 0)]
    df = spark.createDataFrame(rows, "qual string, flag int, want int")
    assert df.where(scoring.read_score("sum_of_base_qualities") != F.col("want")).count() == 0


def test_murmur_against_scalar(spark):
    def one(b: bytes, seed: int = 1) -> int:
        m = 0xFFFFFFFF
        rot = lambda x, r: (x << r | x >> (32 - r)) & m
        cells = [b[i : i + 2] for i in range(0, len(b), 2)]
        h = seed
        for c in cells:
            k = rot((c[0] | (c[1] << 16 if len(c) == 2 else 0)) * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
            h ^= k
            if len(c) == 2:
                h = (rot(h, 13) * 5 + 0xE6546B64) & m
        h ^= 2 * len(b)
        for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> shift) * times & m
        return h ^ h >> 16

    rng = random.Random(6)
    texts = ["", "a", "ab", "abc", *("".join(chr(rng.randint(33, 126)) for _ in range(rng.randint(0, 60))) for _ in range(200))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scoring.murmur3(F.col("t")).alias("h"), scoring.random_score(F.col("t")).alias("s")).collect()
    assert {r.t: r.h for r in got} == {t: one(t.encode()) for t in texts}
    assert {r.t: r.s for r in got} == {t: (one(t.encode()) & 0x3FFF) - 8191 for t in texts}


def test_umis(spark):
    rows = [("AT-GA", "bottom", "GA-AT"), ("AT-GA", "top", "AT-GA"), ("AT-GA", None, "AT-GA"), (None, "top", ""), ("", "bottom", "")]
    df = spark.createDataFrame(rows, "u string, s string, w string")
    assert df.where(umi.top_strand_umi(F.col("u"), F.col("s")) != F.col("w")).count() == 0
    for text, duplex in (("ACGT", True), ("A-C-G", True), ("AX-GA", True), ("A!", False)):
        with pytest.raises(Exception, match="UMI"):
            spark.createDataFrame([(text, "top")], "u string, s string").select(umi.top_strand_umi(F.col("u"), F.col("s"), duplex)).collect()


def flooded(edges):
    """Components by flooding from every node in turn."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, seen = [], set()
    for start in near:
        if start not in seen:
            part, waiting = set(), [start]
            while waiting:
                x = waiting.pop()
                if x not in part:
                    part.add(x)
                    waiting += near[x]
            seen |= part
            found.append(sorted(part))
    return sorted(found)


def test_components():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 25)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 30))]
        u, v = np.array(edges).T
        found: dict[int, set[int]] = {}
        for row, ends in zip(union_find(u, v), (u, v), strict=True):
            for c, x in zip(row.tolist(), ends.tolist(), strict=True):
                found.setdefault(c, set()).add(x)
        assert sorted(map(sorted, found.values())) == flooded(edges)


def test_program_ids():
    ids = ProgramIds(["MarkDuplicates"])
    assert [ids.new("MarkDuplicates"), ids.new("x"), ids.new("x"), ids.new("MarkDuplicates")] == ["MarkDuplicates.0", "x", "x.2", "MarkDuplicates.3"]
    assert [base36(n) for n in (0, 9, 10, 35, 36)] == ["0", "9", "A", "Z", "10"]
    new, records = chain(["bwa", None], ["bwa"], "MD", "MarkDuplicates", "1", "md in.bam")
    assert new == {None: "MD", "bwa": "MD.1"}
    assert records == [{"ID": "MD", "PN": "MarkDuplicates", "VN": "1", "CL": "md in.bam"}, {"ID": "MD.1", "PN": "MarkDuplicates", "VN": "1", "CL": "md in.bam", "PP": "bwa"}]


def flows_read(seq, order, from_start, skip):
    """Bases that the first flows read, flow by flow."""
    bases, flow, count = seq if from_start else seq[::-1], -1, 0
    if not bases or not order or bases[0] not in order:
        return min(1, len(bases)) if order else 0
    for i, (base, run) in enumerate(itertools.groupby(bases)):
        if base not in order:
            break
        flow += 1
        while order[flow % len(order)] != base:
            flow += 1
        if i and flow >= skip:
            break
        count += len(list(run))
    return count


def test_flow_walk(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choices("ACGTTTN", weights=[4, 4, 4, 4, 4, 4, 1], k=rng.randint(0, 40))), rng.choice(["TGCA", "TACG", "TGC", ""]), rng.random() < 0.5, rng.randint(0, 30)) for _ in range(800)]
    df = spark.createDataFrame(rows, "seq string, o string, f boolean, k int")
    got = df.select("seq", "o", "f", "k", flow.walked_bases(F.col("seq"), F.col("o"), F.col("f"), F.col("k")).alias("n")).collect()
    assert [tuple(r) for r in got if r.n != flows_read(r.seq, r.o, r.f, r.k)] == []
    # flows T G C A: TT uses one, G the next, A two more
    assert flows_read("TTGA", "TGCA", True, 1) == 2 and flows_read("TTGA", "TGCA", True, 2) == 3


def test_optical_links_connect_what_edges_connect(spark):
    rng = random.Random(8)
    rows = []
    for rep in range(12):
        spread = rng.choice([30, 300, 900])
        rows += [(rep, 0, "L", rng.randint(0, 1), rng.randint(1, 2), rng.randint(0, spread), rng.randint(0, spread), rep * 1000 + i, 150, 1) for i in range(150)]
    sets = spark.createDataFrame(rows, "rep_idx long, optical_group int, library string, rg_ordinal int, tile int, x int, y int, idx1 long, set_size long, rank int")
    every = optical.clusters(optical.edges(sets, 20)).select("rep_idx", "node", "cluster")
    few = optical.links(sets, 20)
    assert few.count() < optical.edges(sets, 20).count() and few.count() <= 5 * len(rows)
    assert sorted(map(tuple, optical.clusters(few).select("rep_idx", "node", "cluster").collect())) == sorted(map(tuple, every.collect()))


def test_a_hash_takes_no_step_of_its_own_for_each_pair_of_characters(spark):
    names = spark.range(200).select(F.concat(F.repeat(F.lit("ab"), 10_000), F.col("id").cast("string")).alias("t"))
    began = time.perf_counter()
    assert names.select(scoring.murmur3(F.col("t")).alias("h")).distinct().count() == 200
    assert time.perf_counter() - began < 10


def test_a_cigar_without_clips_costs_no_failed_casts(spark):
    def took(text):
        began = time.perf_counter()
        df = spark.range(300_000).withColumn("c", F.concat(F.lit(text), F.substring(F.col("id").cast("string"), 1, 0)))
        df.select(F.sum(cigar.leading_clips(F.col("c")) + cigar.trailing_clips(F.col("c")))).first()
        return time.perf_counter() - began

    took("3H2S40M2S3H")
    assert took("50M") < 3 * took("3H2S40M2S3H") + 1


def test_clusters_take_whole_sets_in_batches(spark):
    edges = spark.createDataFrame([(s, s % 2, 10 * s + i, 10 * s + i + 1) for s in range(500) for i in (0, 1, 4)], "rep_idx long, optical_group int, u long, v long")
    found = optical.clusters(edges)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(s, s % 2, 10 * s + i, 10 * s + (0 if i < 3 else 4)) for s in range(500) for i in (0, 1, 2, 4, 5)]
    assert sorted(map(tuple, found.collect())) == want
