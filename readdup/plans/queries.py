"""Named queries over the reads fixture, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALL, COORDINATE, QUERYNAME, RANDOM, TOTAL_MAPPED_REFERENCE_LENGTH, Options
from ..functions import flow, names, scoring, umi
from ..functions.cigar import unclipped_5prime
from ..functions.flags import REVERSE, has, is_candidate
from ..operators import duplicate_sets, flow_sets, histogram, marking, metrics, optical, pairs, program_groups
from ..operators.ends import orientation, with_library
from ..shared import shared_dir
from ..sources import bam, ends_json, fixture, header, metrics_file, sam
from .markdup import MarkDuplicates
from .oracle import FIVE, LOCATION, REF_LEN, SCORE, query

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Fixed value: the documented example of a read-name pattern.
NAME_PATTERN = r"(?:.*:)?([0-9]+)[^:]*:([0-9]+)[^:]*:([0-9]+)[^:]*$"


def named(sql: str, order: str = "coordinate") -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        FOUND[f.__name__] = f
        SQL[f.__name__] = query(sql, order)
        return f

    return put


def run(spark: SparkSession, sf_dir: str, order: str = COORDINATE, **options: object) -> MarkDuplicates:
    return MarkDuplicates(fixture.reads(spark, sf_dir, order), fixture.read_groups(spark), Options(**options), order)


def run_once(spark: SparkSession, sf_dir: str, order: str = COORDINATE, **options: object) -> MarkDuplicates:
    """A run whose ends, pair sets, duplicates and optical pairs are made once and stored, as several frames need them."""
    job = run(spark, sf_dir, order, **options)
    job.work = shared_dir(spark)
    return job


def single_reads(spark: SparkSession, sf_dir: str, **options: object) -> MarkDuplicates:
    """A run in flow mode, which has rules for reads without a mate only."""
    reads = fixture.reads(spark, sf_dir).where(is_candidate() & ~has(1))
    return MarkDuplicates(reads, fixture.read_groups(spark), Options(flow_mode=True, **options))


@named(f"SELECT idx, {FIVE.format(c='cigar', pos='pos', rev='(flag & 16) <> 0')}::BIGINT AS coord FROM reads WHERE (flag & 2308) = 0")
def unclipped_5prime_ends(spark, sf_dir):
    reads = fixture.reads(spark, sf_dir).where(is_candidate())
    return reads.select("idx", unclipped_5prime(F.col("pos"), F.col("cigar"), has(REVERSE)).alias("coord"))


@named(f"SELECT idx, {LOCATION} FROM reads")
def read_location_default(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", *(c.alias(n) for n, c in names.location(F.col("qname")).items()))


@named("SELECT idx, " + ", ".join(f"TRY_CAST(nullif(regexp_extract(qname, '^(?:{NAME_PATTERN})', {i}), '') AS INT) AS {n}" for i, n in ((1, "tile"), (2, "x"), (3, "y"))) + " FROM reads")
def read_location_regex(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", *(c.alias(n) for n, c in names.location(F.col("qname"), NAME_PATTERN).items()))


@named("SELECT idx, TRY_CAST(nullif(regexp_extract(cigar, '^(-?[0-9]+)', 1), '') AS INT) AS number FROM reads")
def rapid_parse_int(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", names.rapid_parse_int(F.col("cigar")).alias("number"))


@named(f"SELECT idx, CAST({SCORE} AS INT) AS score FROM reads")
def score_sum_base_qualities(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", scoring.read_score("sum_of_base_qualities").alias("score"))


@named(f"SELECT idx, CAST(CASE WHEN (flag & 4) <> 0 THEN 0 ELSE least({REF_LEN.format(c='cigar')}, 16383) END + CASE WHEN (flag & 9) = 1 AND mc IS NOT NULL THEN least({REF_LEN.format(c='mc')}, 16383) ELSE 0 END - CASE WHEN (flag & 512) <> 0 THEN 16384 ELSE 0 END AS INT) AS score FROM reads")
def score_ref_length(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", scoring.read_score(TOTAL_MAPPED_REFERENCE_LENGTH, F.col("mc")).alias("score"))


@named("SELECT idx, ((xor(h, h >> 16) & 16383) - 8191 - CASE WHEN (flag & 512) <> 0 THEN 16384 ELSE 0 END)::INT AS score FROM mur_c")
def score_random(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", scoring.read_score(RANDOM).alias("score"))


@named("SELECT idx, CASE WHEN (flag & 16) <> 0 AND (flag & 32) <> 0 THEN 4 WHEN (flag & 16) <> 0 THEN 5 WHEN (flag & 32) <> 0 THEN 3 ELSE 2 END::INT AS orientation FROM reads")
def orientation_codes(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", orientation(has(16), has(32)).cast("int").alias("orientation"))


@named("SELECT idx, library, rg_ordinal::INT AS rg_ordinal FROM libs")
def library_lookup(spark, sf_dir):
    return with_library(fixture.reads(spark, sf_dir), fixture.read_groups(spark)).select("idx", "library", "rg_ordinal")


@named("SELECT a.idx AS idx_a, b.idx AS idx_b FROM joined")
def mate_join_pairs(spark, sf_dir):
    return pairs.join_mates(run(spark, sf_dir).ends).select(F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"))


@named("SELECT idx1, idx2, library, ref1, coord1::BIGINT AS coord1, ref2, coord2::BIGINT AS coord2, orientation::INT AS orientation, optical_orientation::INT AS optical_orientation, score::INT AS score, tile, x, y FROM pairs")
def pair_canonical(spark, sf_dir):
    return run(spark, sf_dir).pairs.select("idx1", "idx2", "library", "ref1", "coord1", "ref2", "coord2", "orientation", "optical_orientation", "score", "tile", "x", "y")


@named("SELECT idx FROM mated WHERE idx NOT IN (SELECT unnest([a.idx, b.idx]) FROM joined)")
def unmatched_mates(spark, sf_dir):
    return pairs.unmatched(run(spark, sf_dir).ends).select("idx")


@named("SELECT idx1, idx2, rep_idx, set_size, optical_group::INT AS optical_group FROM sets")
def pair_duplicate_sets(spark, sf_dir):
    return run(spark, sf_dir).pair_sets.select("idx1", "idx2", "rep_idx", "set_size", F.col("optical_group").cast("int").alias("optical_group"))


@named("SELECT idx1, idx2, set_size, score::INT AS score FROM sets WHERE rank = 1")
def pair_keeper(spark, sf_dir):
    return run(spark, sf_dir).pair_sets.where("rank = 1").select("idx1", "idx2", "set_size", "score")


@named("SELECT idx FROM pair_dups")
def pair_duplicate_ids(spark, sf_dir):
    return duplicate_sets.pair_duplicates(run(spark, sf_dir).pair_sets)


@named("SELECT idx FROM frag_dups")
def fragment_duplicate_ids(spark, sf_dir):
    return duplicate_sets.fragment_duplicates(run(spark, sf_dir).fragment_sets)


@named("SELECT idx FROM dups")
def all_duplicate_ids(spark, sf_dir):
    return run_once(spark, sf_dir).duplicates


@named("SELECT DISTINCT unnest([idx1, idx2]) AS idx, rep_idx, set_size::INT AS set_size FROM sets WHERE set_size > 1")
def representative_tags(spark, sf_dir):
    return run(spark, sf_dir).representatives


@named("SELECT rep_idx, u, v FROM edges")
def optical_edges(spark, sf_dir):
    return run_once(spark, sf_dir).optical_edges.select("rep_idx", "u", "v")


@named("SELECT rep_idx, node, cluster FROM comps")
def optical_clusters(spark, sf_dir):
    return optical.clusters(run_once(spark, sf_dir).optical_edges).select("rep_idx", "node", "cluster")


@named("SELECT idx1, idx2, rep_idx FROM optical")
def optical_flags(spark, sf_dir):
    return run_once(spark, sf_dir).optical.select("idx1", "idx2", "rep_idx")


@named("SELECT library, optical FROM opt_lib")
def optical_by_library(spark, sf_dir):
    return optical.optical_by_library(run_once(spark, sf_dir).optical)


@named("SELECT idx, new_flag::INT AS flag, is_duplicate, is_optical FROM marks")
def marked_flags(spark, sf_dir):
    return run_once(spark, sf_dir, tagging_policy=ALL).marked.select("idx", "flag", "is_duplicate", "is_optical")


@named("SELECT idx, CASE WHEN is_optical THEN 'SQ' WHEN is_duplicate THEN 'LB' END AS dt FROM marks")
def dt_tags(spark, sf_dir):
    return run_once(spark, sf_dir, tagging_policy=ALL).marked.select("idx", marking.duplicate_type(ALL).alias("dt"))


@named("SELECT idx, new_flag::INT AS flag FROM marks WHERE NOT is_duplicate")
def remove_duplicates(spark, sf_dir):
    return run_once(spark, sf_dir, remove_duplicates=True).output().select("idx", "flag")


@named("SELECT idx, new_flag::INT AS flag FROM marks WHERE NOT is_optical")
def remove_sequencing_duplicates(spark, sf_dir):
    return run_once(spark, sf_dir, remove_sequencing_duplicates=True).output().select("idx", "flag")


@named("SELECT * FROM raw")
def library_metrics_raw(spark, sf_dir):
    return run_once(spark, sf_dir).raw_metrics


@named("SELECT * FROM final")
def library_metrics_final(spark, sf_dir):
    return run_once(spark, sf_dir).metrics


@named("SELECT library, ESTIMATED_LIBRARY_SIZE AS size FROM final")
def library_size_estimate(spark, sf_dir):
    return run_once(spark, sf_dir).metrics.select("library", F.col("ESTIMATED_LIBRARY_SIZE").alias("size"))


@named("""SELECT library, x::DOUBLE AS bin, round(ESTIMATED_LIBRARY_SIZE::DOUBLE * (1 - exp(-(x::DOUBLE * READ_PAIRS_EXAMINED) / ESTIMATED_LIBRARY_SIZE::DOUBLE)) / (READ_PAIRS_EXAMINED - READ_PAIR_DUPLICATES), 9) AS multiple
FROM final, (SELECT unnest(range(1, 101)) AS x) WHERE ESTIMATED_LIBRARY_SIZE IS NOT NULL""")
def roi_curve(spark, sf_dir):
    return metrics.roi_curve(run_once(spark, sf_dir).metrics).select("library", "bin", F.round("CoverageMult", 9).alias("multiple"))


@named("SELECT * FROM histograms")
def setsize_histograms(spark, sf_dir):
    return run_once(spark, sf_dir).set_sizes


@named("""SELECT count(*) AS size, sum(bin * v) AS sum, sum(v) AS sum_of_values, round(sum(bin * v) / sum(v), 9) AS mean,
round(sqrt((sum(bin * bin * v) - sum(v) * (sum(bin * v) / sum(v)) * (sum(bin * v) / sum(v))) / (sum(v) - 1)), 9) AS standard_deviation, round(avg(v), 9) AS mean_bin_size, quantile_cont(v, 0.5) AS median_bin_size
FROM (SELECT set_size::DOUBLE AS bin, count(*)::DOUBLE AS v FROM sets WHERE rank = 1 GROUP BY set_size)""")
def histogram_stats(spark, sf_dir):
    found = histogram.histogram(run(spark, sf_dir).pair_sets.where("rank = 1"), F.col("set_size"))
    s = histogram.statistics(found)
    return s.select("size", "sum", "sum_of_values", *(F.round(c, 9).alias(c) for c in ("mean", "standard_deviation", "mean_bin_size")), "median_bin_size")


@named("SELECT idx, CASE WHEN strand = 'bottom' THEN concat(string_split(rx, '-')[2], '-', string_split(rx, '-')[1]) ELSE rx END AS umi FROM strands")
def umi_normalized(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", umi.top_strand_umi(F.col("rx"), umi.template_strand(F.col("mc"))).alias("umi"))


@named("SELECT idx, strand FROM strands")
def umi_strand(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", umi.template_strand(F.col("mc")).alias("strand"))


@named(f"SELECT idx, concat('chr', (tid + 1)::VARCHAR, ':', CASE WHEN (flag & 16) <> 0 THEN pos ELSE pos + {REF_LEN.format(c='cigar')} - 1 END::BIGINT::VARCHAR, '/', CASE strand WHEN 'top' THEN '/A' WHEN 'bottom' THEN '/B' ELSE '' END) AS mi FROM strands WHERE (flag & 2308) = 0")
def molecular_identifier(spark, sf_dir):
    reads = fixture.reads(spark, sf_dir).where(is_candidate())
    contig = F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string"))
    return reads.select("idx", umi.molecular_identifier(contig, umi.template_strand(F.col("mc")), duplex=True).alias("mi"))


@named("SELECT idx1, idx2, rep_idx, set_size FROM barcode_sets")
def barcode_duplicate_sets(spark, sf_dir):
    return run(spark, sf_dir, barcode_tag="BC").pair_sets.select("idx1", "idx2", "rep_idx", "set_size")


@named("SELECT idx, CAST(least(sum(CASE WHEN q >= 15 THEN q ELSE 0 END), 16383) - CASE WHEN (any_value(flag) & 512) <> 0 THEN 16384 ELSE 0 END AS INT) AS score FROM flow_quals GROUP BY idx")
def flow_score(spark, sf_dir):
    return fixture.reads(spark, sf_dir).select("idx", flow.flow_score(15, F.lit(1)).alias("score"))


CHAINED = {"flow_skip_first_n_flows": 2, "flow_quality_sum_strategy": True, "use_end_in_unpaired_reads": True, "unpaired_end_uncertainty": 10}


@named("SELECT idx, library, ref, coord::BIGINT AS coord, far::BIGINT AS far, chunk::BIGINT AS chunk, score::INT AS score FROM flow_sets")
def flow_end_groups(spark, sf_dir):
    """Single reads in flow mode: near end behind two flows, far ends chained within 10 bases."""
    job = single_reads(spark, sf_dir, **CHAINED)
    return flow_sets.chained_sets(job.ends, job.options.unpaired_end_uncertainty).select("idx", "library", "ref", "coord", "far", "chunk", "score")


@named("SELECT idx FROM flow_best WHERE nth > 1")
def flow_duplicate_ids(spark, sf_dir):
    return single_reads(spark, sf_dir, **CHAINED).duplicates


@named("SELECT idx, (CASE WHEN reverse THEN ue ELSE us END)::BIGINT AS coord, far_q::BIGINT AS far, plain::INT AS score FROM flow_far")
def flow_known_ends(spark, sf_dir):
    """Ends that the tm tag knows, Q as well as A; scores by base qualities."""
    return single_reads(spark, sf_dir, flow_q_is_known_end=True, use_end_in_unpaired_reads=True).ends.select("idx", "coord", "far", "score")


@named("SELECT idx, tight::BIGINT AS coord, tight_away::BIGINT AS far FROM flow_far")
def flow_clipped_ends(spark, sf_dir):
    """Aligned ends, clipped bases left out, in place of unclipped ones."""
    return single_reads(spark, sf_dir, use_unpaired_clipped_end=True, use_end_in_unpaired_reads=True).ends.select("idx", "coord", "far")


@named("SELECT idx, fo AS flow_order FROM flow_reads")
def flow_orders(spark, sf_dir):
    job = single_reads(spark, sf_dir)
    return flow_sets.with_flow_order(job.reads, job.read_groups).select("idx", "flow_order")


@named("""SELECT r.library, count(*) AS UNPAIRED_READS_EXAMINED, count(*) FILTER (WHERE r.idx IN (SELECT idx FROM flow_best WHERE nth > 1)) AS UNPAIRED_READ_DUPLICATES, 0::BIGINT AS UNPAIRED_WITH_TLEN FROM flow_reads r GROUP BY r.library""")
def flow_metrics(spark, sf_dir):
    return single_reads(spark, sf_dir, **CHAINED).metrics.select("library", "UNPAIRED_READS_EXAMINED", "UNPAIRED_READ_DUPLICATES", "UNPAIRED_WITH_TLEN")


@named("SELECT idx1, idx2, rep_idx, set_size FROM slot_sets")
def read_barcode_duplicate_sets(spark, sf_dir):
    """Barcodes of the first and of the second read apart."""
    return run(spark, sf_dir, read_one_barcode_tag="BX", read_two_barcode_tag="BZ").pair_sets.select("idx1", "idx2", "rep_idx", "set_size")


@named("SELECT idx1, idx2, rep_idx, set_size FROM umi_sets")
def duplex_umi_duplicate_sets(spark, sf_dir):
    return run(spark, sf_dir, barcode_tag="RX", duplex_umi=True).pair_sets.select("idx1", "idx2", "rep_idx", "set_size")


@named("SELECT rep_idx, u, v FROM edges WHERE rep_idx IN (SELECT rep_idx FROM sets WHERE set_size <= 3)")
def optical_edges_of_small_sets(spark, sf_dir):
    """Sets of more pairs than the guard allows have no optical duplicates."""
    return run_once(spark, sf_dir, max_optical_set_size=3).optical_edges.select("rep_idx", "u", "v")


@named("SELECT count(*) AS optical FROM optical")
def optical_total(spark, sf_dir):
    return run_once(spark, sf_dir).optical.agg(F.count(F.lit(1)).alias("optical"))


@named("SELECT 1.0::DOUBLE AS bin, count(*)::DOUBLE AS all_sets, 0.0::DOUBLE AS optical_sets, count(*)::DOUBLE AS non_optical_sets FROM sets WHERE set_size = 1 HAVING count(*) > 0")
def setsize_histograms_without_names(spark, sf_dir):
    """Without read names only single pairs are recorded."""
    return run_once(spark, sf_dir, read_name_regex="").set_sizes


@named("SELECT l.idx, CASE WHEN l.qname IN (SELECT qname FROM turns) THEN l.flag | 1024 ELSE l.flag & ~1024 END::INT AS flag FROM libs l", QUERYNAME)
def queryname_marked_flags(spark, sf_dir):
    """In queryname order the mark is on all records of the name."""
    return run_once(spark, sf_dir, QUERYNAME).marked.select("idx", "flag")


@named("SELECT a.idx AS idx_a, b.idx AS idx_b FROM joined", QUERYNAME)
def queryname_mate_pairs(spark, sf_dir):
    return pairs.join_mates(run(spark, sf_dir, QUERYNAME).ends).select(F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"))


@named("""SELECT m.idx, CASE WHEN is_optical THEN 'Z:SQ' WHEN is_duplicate THEN 'Z:LB' END AS dt, 'i:' || r.rep_idx::VARCHAR AS di, 'i:' || r.set_size::VARCHAR AS ds
FROM marks m LEFT JOIN (SELECT DISTINCT unnest([idx1, idx2]) AS idx, rep_idx, set_size FROM sets WHERE set_size > 1) r ON m.idx = r.idx""")
def written_tags(spark, sf_dir):
    """DT, DI and DS as they stand in the tags of the output."""
    job = run_once(spark, sf_dir, tagging_policy=ALL, tag_duplicate_set_members=True)
    job.reads = fixture.with_tags(job.reads)
    return job.output().select("idx", *(F.try_element_at("tags", F.lit(t)).alias(t.lower()) for t in ("DT", "DI", "DS")))


@named("SELECT library FROM final WHERE (SELECT count(*) FROM final) = 1")
def roi_scope(spark, sf_dir):
    """The return on sequencing is only of a file with one library; this one has several."""
    found = run_once(spark, sf_dir).roi()
    return spark.createDataFrame([], "library string") if found is None else found.select("library").distinct()


@named("SELECT (SELECT count(*) FROM reads) AS records, (SELECT count(*) FROM ends) AS ends, (SELECT count(*) FROM joined) AS pairs, (SELECT count(*) FROM mated) - 2 * (SELECT count(*) FROM joined) AS unmatched, (SELECT count(*) FROM dups) AS duplicates, (SELECT count(*) FROM optical) AS optical")
def run_counters(spark, sf_dir):
    return run_once(spark, sf_dir).counters


@named("SELECT DISTINCT pg FROM reads")
def distinct_pg(spark, sf_dir):
    return program_groups.distinct_programs(fixture.reads(spark, sf_dir))


@named("SELECT idx, CASE WHEN pg IS NULL THEN 'MarkDuplicates.0' WHEN pg = 'MarkDuplicates' THEN 'MarkDuplicates.1' WHEN pg = 'bwa' THEN 'MarkDuplicates.2' ELSE 'MarkDuplicates.3' END AS pg FROM reads")
def pg_chain(spark, sf_dir):
    """Program ids after a run over a header that has MarkDuplicates, bwa and bwa.1 already."""
    reads = fixture.with_tags(fixture.reads(spark, sf_dir))
    seen = [r.pg for r in program_groups.distinct_programs(reads).collect()]  # program records of the header
    new, _ = program_groups.chain(seen, ["bwa", "bwa.1", "MarkDuplicates"], "MarkDuplicates", "MarkDuplicates")
    return program_groups.rewritten(reads, new).select("idx", F.substring(F.col("tags")["PG"], 3, 1 << 30).alias("pg"))


HEAD = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:chr{i}\tLN:100000000" for i in (1, 2, 3)), *(f"@RG\tID:RG{i}" for i in range(4))]
FILE_COLUMNS = ("idx", "qname", "flag", "tid", "pos", "cigar", "mtid", "mpos", "seq", "qual", "rg")
TAG_COLUMNS = [c for c, _, _ in fixture.TAGS]


def from_file(reads: DataFrame) -> DataFrame:
    tags = [F.substring(F.try_element_at("tags", F.lit(tag)), 3, 1 << 30).alias(c) for c, tag, _ in fixture.TAGS]
    return reads.select(*FILE_COLUMNS, *tags)


def in_file_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as files have them, with qualities and lengths that the fixture lacks."""
    reads = fixture.with_tags(fixture.reads(spark, sf_dir))
    return reads.select("*", F.lit(60).alias("mapq"), F.lit(0).cast("long").alias("tlen"))


@named(f"SELECT {', '.join(FILE_COLUMNS)}, {', '.join(TAG_COLUMNS)} FROM reads")
def bam_round_trip(spark, sf_dir):
    """Written as a folder of BAM files, read back in small splits."""
    path = f"{shared_dir(spark)}/reads.bam"
    bam.write(in_file_schema(spark, sf_dir), HEAD, path)
    return from_file(bam.read(spark, path, 1 << 18))


@named(f"SELECT {', '.join(FILE_COLUMNS)}, {', '.join(TAG_COLUMNS)} FROM reads")
def sam_round_trip(spark, sf_dir):
    """Written as SAM text and read back, rows numbered by their place."""
    path = f"{shared_dir(spark)}/reads.sam"
    sam.write(in_file_schema(spark, sf_dir), HEAD, [n for n, _ in header.contigs(HEAD)], path)
    return from_file(sam.read(spark, path))


@named("SELECT idx1 AS read1, idx2 AS read2, score::INT AS score, tile, x, y FROM pairs")
def json_round_trip(spark, sf_dir):
    """Pairs as JSON arrays and back."""
    path = f"{shared_dir(spark)}/ends"
    own = run(spark, sf_dir).pairs.select(F.col("idx1").alias("read1IndexInFile"), F.col("idx2").alias("read2IndexInFile"), "score", "tile", "x", "y")
    ends_json.write(own, path)
    return ends_json.read(spark, path).select(F.col("read1IndexInFile").alias("read1"), F.col("read2IndexInFile").alias("read2"), "score", "tile", "x", "y")


@named("SELECT library, READ_PAIRS_EXAMINED::VARCHAR AS pairs, READ_PAIR_DUPLICATES::VARCHAR AS duplicates, READ_PAIR_OPTICAL_DUPLICATES::VARCHAR AS optical, coalesce(ESTIMATED_LIBRARY_SIZE::VARCHAR, '') AS size FROM final")
def metrics_file_table(spark, sf_dir):
    """The table of a metrics file, read back as text."""
    job = run_once(spark, sf_dir)
    text = metrics_file.render(job.metrics, job.set_sizes, ["a command"]).split("\n")
    at = next(i for i, x in enumerate(text) if x.startswith("## METRICS CLASS"))
    rows = [dict(zip(text[at + 1].split("\t"), x.split("\t"), strict=True)) for x in text[at + 2 : text.index("", at)]]
    names = {"library": "LIBRARY", "pairs": "READ_PAIRS_EXAMINED", "duplicates": "READ_PAIR_DUPLICATES", "optical": "READ_PAIR_OPTICAL_DUPLICATES", "size": "ESTIMATED_LIBRARY_SIZE"}
    return spark.createDataFrame([tuple(r[c] for c in names.values()) for r in rows], ", ".join(f"{n} string" for n in names))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
