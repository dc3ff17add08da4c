"""Tab-separated reports: a few rows each, written by the driver."""

from __future__ import annotations

import gzip
import os

from pyspark.sql import DataFrame


def _text(value) -> str:
    return "" if value is None else f"{value:.6f}" if isinstance(value, float) else str(value)


def write(rows: DataFrame, path: str) -> None:
    """A header and one line per row; .gz and .bgz names are compressed. rows is a report: one row per library."""
    lines = ["\t".join(rows.columns), *("\t".join(map(_text, r)) for r in rows.collect())]
    opened = gzip.open(path, "wt") if path.endswith((".gz", ".bgz")) else open(path, "w")  # noqa: SIM115
    with opened as f:
        f.write("".join(x + "\n" for x in lines))


def append(rows: DataFrame, path: str) -> None:
    """Add rows; the header only if the file is new or empty."""
    fresh = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "a") as f:
        if fresh:
            f.write("\t".join(rows.columns) + "\n")
        for r in rows.collect():
            f.write("\t".join(map(_text, r)) + "\n")
