"""The product of relations; with the conditions of WHERE above it, Catalyst forms the joins."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.crossJoin(b), frames)


def bound_product(domain: DataFrame, frames: list[DataFrame], bound: list[list[str]]) -> DataFrame:
    """The product of a domain's rows with the frames; those that have copies of the domain's columns
    (``bound``, in its order) meet only the domain's rows of equal values."""
    out = domain
    for frame, copies in zip(frames, bound, strict=True):
        if copies:
            same = functools.reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(d)) for c, d in zip(domain.columns, copies, strict=True)))
            out = out.join(frame, same).drop(*copies)
        else:
            out = out.crossJoin(frame)
    return out
