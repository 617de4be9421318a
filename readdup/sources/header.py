"""SAM headers as lists of lines, on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import QUERYNAME, SORT_ORDERS, Options

READ_GROUPS = "rg_id string, rg_ordinal int, library string, flow_order string"


def fields(line: str) -> dict[str, str]:
    return dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)


def records(header: list[str], kind: str) -> list[dict[str, str]]:
    return [fields(x) for x in header if x.startswith(f"@{kind}\t") or x == f"@{kind}"]


def sort_order(header: list[str]) -> str:
    """The SO of the first line of the header; it must be there and be one of the four orders."""
    found = (records(header, "HD") or [{}])[0].get("SO")
    if found not in SORT_ORDERS:
        raise ValueError(f"the header's sort order is missing or unknown: {found}")
    return found


def read_groups(spark: SparkSession, header: list[str]) -> DataFrame:
    rows = [(r["ID"], i, r.get("LB"), r.get("FO")) for i, r in enumerate(records(header, "RG"))]
    return spark.createDataFrame(rows, READ_GROUPS)


def contigs(header: list[str]) -> list[tuple[str, int]]:
    return [(r["SN"], int(r["LN"])) for r in records(header, "SQ")]


def output_header(header: list[str], options: Options, programs: list[dict[str, str]] = ()) -> list[str]:
    """The header to write: with an assumed queryname order it says grouped by query, then program records and comments follow."""
    out = list(header)
    if options.assume_sort_order == QUERYNAME:
        first = fields(out[0]) if out and out[0].startswith("@HD") else {"VN": "1.6"}
        line = "\t".join(["@HD", *(f"{k}:{v}" for k, v in (first | {"SO": "unknown", "GO": "query"}).items())])
        out = [line, *out[bool(out and out[0].startswith("@HD")) :]]
    out += ["\t".join(["@PG", *(f"{k}:{v}" for k, v in p.items())]) for p in programs]
    return out + [f"@CO\t{c}" for c in options.comment]
