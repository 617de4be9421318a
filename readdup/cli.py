"""Duplicate marking from file to file: ``python -m readdup --input IN.bam --output OUT.bam --metrics-file METRICS``."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import shlex
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Options
from .operators import program_groups
from .plans.markdup import MarkDuplicates
from .shared import shared_dir
from .sources import bam, header, metrics_file, sam

log = logging.getLogger("readdup")


def parser() -> argparse.ArgumentParser:
    """One option for each field of Options, and --parts."""
    out = argparse.ArgumentParser(prog="readdup", description=__doc__)
    for f in dataclasses.fields(Options):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            out.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        elif f.default is dataclasses.MISSING:
            out.add_argument(name, action="append", default=[])
        else:
            out.add_argument(name, type=int if isinstance(f.default, int) else str, default=f.default)
    out.add_argument("--parts", action="store_true", help="write a folder of BAM files, one a partition, instead of joining them on the driver")
    return out


def read(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header's lines and the records of a SAM text or BAM file."""
    if path.endswith(".sam"):
        return sam.header(spark, path), sam.read(spark, path)
    return bam.header(path), bam.read(spark, path)


def histograms(job: MarkDuplicates) -> DataFrame:
    """Set sizes, with the return on sequencing beside them where the file has one library."""
    curve = job.roi()
    if curve is None:
        return job.set_sizes
    return curve.select("bin", "CoverageMult").join(job.set_sizes, "bin", "full").select("bin", "CoverageMult", "all_sets", "optical_sets", "non_optical_sets")


def mark_file(spark: SparkSession, options: Options, parts: bool = False, command: str = "") -> dict[str, int]:
    """Mark the one input, write output and metrics file where they are asked for; the run's counters."""
    started, path = datetime.now(), options.only_input()
    head, reads = read(spark, path)
    order = options.sort_order((header.records(head, "HD") or [{}])[0].get("SO"))
    groups = header.read_groups(spark, head)
    job = MarkDuplicates(reads, groups, options, order, shared_dir(spark))
    try:
        if options.output:
            names = [n for n, _ in header.contigs(head)]
            contig = F.try_element_at(F.array(*map(F.lit, names)), F.col("tid") + 1) if names else None
            out, records = job.output(contig), []
            if options.program_record_id:
                # as many as the input has program records
                seen = [r.pg for r in program_groups.distinct_programs(reads).collect()]
                taken = [r["ID"] for r in header.records(head, "PG")]
                new, records = program_groups.chain(seen, taken, options.program_record_id, options.program_group_name, options.program_group_version, options.program_group_command_line or command or None)
                if options.add_pg_tag_to_reads:
                    out = program_groups.rewritten(out, new)
            lines = header.output_header(head, options, records)
            if options.output.endswith(".sam"):
                sam.write(out, lines, names, options.output)
            else:
                bam.write(out, lines, options.output, single=not parts)
        if options.metrics_file:
            metrics_file.write(options.metrics_file, job.metrics, histograms(job), [x for x in (command,) if x], started)
        counters = job.counters.first().asDict()
        log.info("records %(records)d, ends %(ends)d, pairs %(pairs)d, ends without their mate %(unmatched)d, duplicate reads %(duplicates)d, optical pairs %(optical)d", counters)
        return counters
    finally:
        job.close()


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    given = vars(parser().parse_args(args))
    parts = given.pop("parts")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("readdup").getOrCreate()
    mark_file(spark, Options(**given), parts, shlex.join(["readdup", *args]))
    return 0
