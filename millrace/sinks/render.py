"""Results as text. Rows come from the driver's iterator, one partition at a time."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame


def cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def _rows(frame: DataFrame) -> Iterable[list[str]]:
    return ([cell(v) for v in row] for row in frame.toLocalIterator())


def markdown(frame: DataFrame, out: TextIO) -> None:
    """A table padded to its widest cells; it needs all rows at once, so it is for small results."""
    rows = list(_rows(frame))
    if not rows:
        out.write("(no results)\n")
        return
    widths = [max(map(len, column)) for column in zip(frame.columns, *rows, strict=True)]
    for line in (frame.columns, ["-" * w for w in widths], *rows):
        out.write("| " + " | ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)) + " |\n")


def delimited(frame: DataFrame, out: TextIO, delimiter: str = ",") -> None:
    writer = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    writer.writerow(frame.columns)
    writer.writerows(_rows(frame))


FORMATS = {"markdown": markdown, "csv": delimited}
