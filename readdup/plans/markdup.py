"""The whole run as one lazy plan: ends, pairs, sets, optical clusters, marks, metrics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COORDINATE, Options
from ..operators import duplicate_sets, ends, flow_sets, marking, metrics, optical, pairs
from ..shared import remove, stored


@dataclass
class MarkDuplicates:
    """Frames of a run over ``reads`` and the header's ``read_groups``; each is planned when it is asked for.

    In queryname order marks, DI and DS go to the name, so that all its records have them. With ``work``, a folder made
    by shared_dir(), ends, pair sets, duplicates and optical pairs are stored in it once, for all frames that need them;
    close() deletes them.
    """

    reads: DataFrame
    read_groups: DataFrame
    options: Options
    order: str = COORDINATE
    work: str | None = None

    def once(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, f"{self.work}/{name}") if self.work else df

    def close(self) -> None:
        if self.work:
            remove(self.reads.sparkSession, self.work)

    @cached_property
    def ends(self) -> DataFrame:
        if self.options.flow_mode:
            return self.once(flow_sets.flow_ends(self.reads, self.read_groups, self.options), "ends")
        return self.once(ends.read_ends(self.reads, self.read_groups, self.options), "ends")

    @cached_property
    def pairs(self) -> DataFrame:
        return pairs.pairs(self.ends)

    @cached_property
    def pair_sets(self) -> DataFrame:
        return self.once(duplicate_sets.pair_sets(self.pairs, self.options.use_barcodes), "pair_sets")

    @cached_property
    def fragment_sets(self) -> DataFrame:
        return duplicate_sets.fragment_sets(self.ends, self.options.use_barcodes)

    @cached_property
    def duplicates(self) -> DataFrame:
        if self.options.flow_mode:
            return self.once(flow_sets.flow_duplicates(self.ends, self.options), "duplicates")
        return self.once(duplicate_sets.duplicates(self.pair_sets, self.fragment_sets), "duplicates")

    @cached_property
    def representatives(self) -> DataFrame:
        return duplicate_sets.representatives(self.pair_sets)

    @cached_property
    def optical_edges(self) -> DataFrame:
        sets = self.pair_sets if self.options.read_name_regex else self.pair_sets.limit(0)
        return optical.edges(sets, self.options.optical_distance, self.options.max_optical_set_size)

    @cached_property
    def optical(self) -> DataFrame:
        sets = self.pair_sets if self.options.read_name_regex else self.pair_sets.limit(0)
        return self.once(optical.optical_pairs(sets, self.options.optical_distance, self.options.max_optical_set_size), "optical")

    @cached_property
    def marked(self) -> DataFrame:
        """All reads with is_duplicate, is_optical and the flag to match; nothing is dropped yet."""
        places = optical.optical_duplicates(self.optical) if self.options.need_optical_ids else None
        return marking.marked(self.reads, self.duplicates, places, self.order)

    def output(self, contigs: Column | None = None) -> DataFrame:
        """The reads to write: flags and tags set, removed duplicates gone."""
        out = self.marked
        if self.options.tag_duplicate_set_members:
            out = marking.with_set_members(out, self.representatives, self.order)
        if "tags" in out.columns:
            out = marking.tagged(out, self.options, contigs)
        return marking.kept(out, self.options)

    @cached_property
    def raw_metrics(self) -> DataFrame:
        return metrics.raw_counts(ends.with_library(self.marked, self.read_groups))

    @cached_property
    def metrics(self) -> DataFrame:
        return metrics.final_metrics(self.raw_metrics, optical.optical_by_library(self.optical), self.options.flow_mode)

    @cached_property
    def counters(self) -> DataFrame:
        """One row: how many records, ends, pairs, ends whose mate never came, duplicate reads and optical pairs the run met."""
        one = F.lit(1)
        counts = [
            ("records", self.reads), ("ends", self.ends), ("pairs", self.pairs), ("unmatched", pairs.unmatched(self.ends)), ("duplicates", self.duplicates), ("optical", self.optical),
        ]
        each = reduce(DataFrame.unionByName, (df.agg(F.count(one).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts))
        return each.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name, _ in counts))

    def roi(self) -> DataFrame | None:
        """The return on sequencing, for a file of exactly one library."""
        return metrics.roi_curve(self.metrics) if self.metrics.count() == 1 else None

    @cached_property
    def set_sizes(self) -> DataFrame:
        """Set-size histograms; without read-name pattern only single pairs are recorded."""
        sets = self.pair_sets if self.options.read_name_regex else self.pair_sets.where("set_size = 1")
        return metrics.set_size_histograms(sets, self.optical)


def run(reads: DataFrame, read_groups: DataFrame, options: Options, header_order: str | None = COORDINATE) -> MarkDuplicates:
    """A run in the order that the options and the header give; the order is checked first."""
    return MarkDuplicates(reads, read_groups, options, options.sort_order(header_order))
