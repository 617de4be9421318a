"""Flow-cell locations from read names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_NAMES
from .scoring import let


def found_int(text: Column, pattern: str, group: int) -> Column:
    """A group of a pattern as an integer; null where it is empty, which is told without a cast that fails, or doesn't fit."""
    return let(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x).try_cast("int"))


def rapid_parse_int(text: Column) -> Column:
    """The integer at a text's beginning, whatever follows; null where there is none or it doesn't fit."""
    return found_int(text, r"^(-?[0-9]+)", 1)


def location(name: Column, pattern: str = DEFAULT_NAMES) -> dict[str, Column]:
    """tile, x and y of a read name, all null unless all three are found.

    By default a name has five or seven fields between colons, of which the last three count. A pattern must match the
    whole name and have them as its first three groups. An empty pattern finds none.
    """
    if not pattern:
        return {c: F.lit(None).cast("int") for c in ("tile", "x", "y")}
    if pattern == DEFAULT_NAMES:
        three = let(F.split(name, ":"), lambda parts: F.when(F.size(parts).isin(5, 7), F.struct(*(rapid_parse_int(F.element_at(parts, -i)).alias(c) for c, i in (("tile", 3), ("x", 2), ("y", 1))))))
    else:
        three = F.struct(*(found_int(name, f"^(?:{pattern})$", i).alias(c) for c, i in (("tile", 1), ("x", 2), ("y", 3))))
    found = let(three, lambda s: F.when(s["tile"].isNotNull() & s["x"].isNotNull() & s["y"].isNotNull(), s))
    return {c: found[c] for c in ("tile", "x", "y")}
