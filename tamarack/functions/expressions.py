"""Expressions as Spark columns, with the dialect's typing.

Whole numbers are computed as BIGINT, and dividing them truncates. Text used as a number - in
arithmetic, or held against a number - is cast and fails where it isn't one. Two texts compare by
their bytes. Doubles come from AVG and from tables that have them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, DOUBLE, TEXT, OTHER = "integer", "double", "text", "other"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return INTEGER
    if isinstance(data_type, T.FractionalType):
        return DOUBLE
    return TEXT if isinstance(data_type, T.StringType) else OTHER


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str

    def number(self) -> Typed:
        if self.kind in (INTEGER, TEXT):
            return Typed(self.column.cast("bigint"), INTEGER)
        return self


def literal(value: int | str) -> Typed:
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), INTEGER)
    return Typed(F.lit(value), TEXT)


def arithmetic(op: str, left: Typed, right: Typed) -> Typed:
    a, b = left.number(), right.number()
    kind = INTEGER if a.kind == b.kind == INTEGER else DOUBLE
    if op == "+":
        return Typed(a.column + b.column, kind)
    if op == "-":
        return Typed(a.column - b.column, kind)
    if op == "*":
        return Typed(a.column * b.column, kind)
    return Typed(F.call_function("div", a.column, b.column) if kind == INTEGER else a.column / b.column, kind)


def comparison(op: str, left: Typed, right: Typed) -> Column:
    a, b = left, right
    if TEXT in (a.kind, b.kind) and {a.kind, b.kind} & {INTEGER, DOUBLE}:
        a, b = a.number(), b.number()
    x, y = a.column, b.column
    return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def aggregate(function: str, argument: Typed | None) -> Typed:
    """COUNT counts rows. MIN, MAX and AVG of text take the text as numbers, as their arguments are."""
    if function == "count":
        return Typed(F.count(F.lit(1)), INTEGER)
    value = argument.number() if argument.kind == TEXT else argument
    if function == "avg":
        return Typed(F.avg(value.column), DOUBLE)
    return Typed((F.min if function == "min" else F.max)(value.column), value.kind)
