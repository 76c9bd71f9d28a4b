"""Results as text: comma-separated, as a table of fixed cells, or as a folder of CSV files.

The text forms take a partition at a time to the driver; :func:`save` writes where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame

CELL = 20


def cell(value) -> str:
    """Doubles have twelve significant digits and always a dot: ``13.``, ``15.3333333333``."""
    if isinstance(value, float):
        text = f"{value:.12g}"
        return text if any(c in text for c in ".en") else text + "."
    return "" if value is None else str(value)


def lines(df: DataFrame) -> Iterator[str]:
    yield ", ".join(df.columns)
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield ", ".join(map(cell, row))


def write_text(df: DataFrame, out: TextIO) -> None:
    for line in lines(df):
        out.write(line + "\n")


def _fixed(text: str) -> str:
    return (text if len(text) <= CELL else text[: CELL - 3] + "...").ljust(CELL)


def write_pretty(df: DataFrame, out: TextIO) -> None:
    rule = "+" + "+".join("-" * CELL for _ in df.columns) + "+\n"
    out.write(rule + "|" + "|".join(map(_fixed, df.columns)) + "|\n" + rule)
    for row in df.toLocalIterator(prefetchPartitions=True):
        out.write("|" + "|".join(_fixed(cell(x)) for x in row) + "|\n")
    out.write(rule)


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with headers, written by the executors. Columns need different names."""
    df.write.mode(mode).option("header", True).csv(path)
