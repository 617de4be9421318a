"""The metrics file: headers, one table of metrics, histograms beside each other. The frames have a row a library and a row a bin, so the driver writes them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from .bam import place


def shown(x: object) -> str:
    """Numbers with six decimals at most, without trailing zeros; nothing for null."""
    if x is None:
        return ""
    return f"{x:.6f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)


def render(metrics: DataFrame, histograms: DataFrame | None = None, headers: list[str] = (), started: datetime | None = None) -> str:
    """The file's text. ``histograms`` has a column bin and one column a histogram."""
    out = []
    for x in [*headers, f"Started on: {(started or datetime.now()).strftime('%a %b %d %H:%M:%S %Y')}"]:
        out += ["## HEADER", f"# {x}"]
    out += ["", "## METRICS CLASS\treaddup.DuplicationMetrics", "\t".join(c.upper() for c in metrics.columns)]
    out += ["\t".join(map(shown, r)) for r in metrics.orderBy("library").collect()]
    if histograms is not None:
        out += ["", "## HISTOGRAM\tjava.lang.Double", "\t".join(histograms.columns)]
        out += ["\t".join(shown(x) if x is not None else "0" for x in r) for r in histograms.orderBy("bin").collect()]
    return "\n".join(out) + "\n\n"


def write(path: str, *args: object, **more: object) -> None:
    """The file's text at a local path or a URI of any file system that pyarrow knows."""
    system, inner = place(path)
    with system.open_output_stream(inner) as f:
        f.write(render(*args, **more).encode())
