"""UNION and MINUS, by position; both frames have the same column names."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _alike(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where one side's column is text and the other's isn't, both become text."""
    mixed = {x.name for x, y in zip(a.schema, b.schema, strict=True) if (x.dataType.typeName() == "string") != (y.dataType.typeName() == "string")}
    cast = [F.col(c).cast("string").alias(c) if c in mixed else F.col(c) for c in a.columns]
    return (a.select(*cast), b.select(*cast)) if mixed else (a, b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row of either side once."""
    a, b = _alike(a, b)
    return a.union(b).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The left rows, as often as they occur, that the right side doesn't have."""
    a, b = _alike(a, b)
    right = b.toDF(*(f"{c}_r" for c in b.columns))
    same = functools.reduce(lambda x, y: x & y, (a[c].eqNullSafe(right[f"{c}_r"]) for c in a.columns))
    return a.join(right, same, "left_anti")


def minus_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = _alike(a, b)
    return a.subtract(b)
