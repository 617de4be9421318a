"""Program records: distinct ids among the reads, new ids for this run, and the reads' ids rewritten."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ends import tag_value
from .marking import put_tag

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def base36(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n, 36)
        out = DIGITS[k] + out
    return out or "0"


class ProgramIds:
    """Gives out ids that a header doesn't have yet: the wished one, or it with ``.`` and a base-36 number."""

    def __init__(self, taken: Iterable[str] = ()):
        self.taken, self.count = set(taken), 0

    def new(self, wished: str) -> str:
        name = wished
        while name in self.taken:
            name = f"{wished}.{base36(self.count)}"
            self.count += 1
        if name == wished:
            self.count += 1
        self.taken.add(name)
        return name


def distinct_programs(reads: DataFrame) -> DataFrame:
    """(pg): the program ids that reads carry, null among them where some read has none."""
    return reads.select(tag_value(reads, "PG").alias("pg")).distinct()


def chain(seen: list[str | None], taken: Iterable[str], record_id: str, name: str, version: str | None = None, command: str | None = None) -> tuple[dict[str | None, str], list[dict[str, str]]]:
    """For each id seen a new one of this run, and the new header records, each with its predecessor (PP); ids are given in ascending order."""
    ids, new, records = ProgramIds(taken), {}, []
    for old in sorted(seen, key=lambda x: (x is not None, x or "")):
        new[old] = ids.new(record_id)
        record = {"ID": new[old], "PN": name, "VN": version, "CL": command, "PP": old}
        records.append({k: v for k, v in record.items() if v is not None})
    return new, records


def rewritten(reads: DataFrame, new: dict[str | None, str]) -> DataFrame:
    """Reads with the new program id for their old one, set in place of it. ``new`` has an entry for each program record."""
    old = tag_value(reads, "PG")
    value = F.lit(new.get(None)).cast("string")
    for k, v in new.items():
        if k is not None:
            value = F.when(old == k, v).otherwise(value)
    return reads.withColumn("tags", F.when(value.isNotNull(), put_tag(F.col("tags"), "PG", value)).otherwise(F.col("tags")))
