"""IN and NOT IN where a subquery refers outside in ways that Spark's own subqueries don't have."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def marked(frame: DataFrame, values: list[Column], hits: DataFrame, mark: str) -> tuple[DataFrame, Column]:
    """``frame`` with a mark on the rows whose ``values`` are a row of ``hits``, and the condition that it is set."""
    same = functools.reduce(lambda x, y: x & y, (v.eqNullSafe(F.col(c)) for v, c in zip(values, hits.columns, strict=True)))
    out = frame.join(hits.withColumn(mark, F.lit(True)), same, "left").select(*frame.columns, mark)
    return out, F.col(mark).isNotNull()
