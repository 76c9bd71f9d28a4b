"""The syntax tree. Nodes are frozen, so equal expressions compare equal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass


@dataclass(frozen=True)
class Number:
    value: int


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Name:
    """A column as written: ``table`` is empty where it isn't qualified."""

    table: str
    column: str


@dataclass(frozen=True)
class Ref:
    """A resolved column: its unique name, and how many queries further out it belongs."""

    column: str
    depth: int = 0


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Aggregate:
    """``argument`` is None for all rows."""

    function: str
    argument: Expr | None


Expr = Number | Text | Name | Ref | Arithmetic | Aggregate


@dataclass(frozen=True)
class Comparison:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Logical:
    op: str
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Membership:
    value: Expr
    query: Query
    negated: bool


Condition = Comparison | Logical | Membership


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class Relation:
    """A table's path or name, or a query, under an alias."""

    source: str | Query
    alias: str


@dataclass(frozen=True)
class OrderKey:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Select:
    """``items`` is empty for all columns."""

    items: tuple[Item, ...]
    relations: tuple[Relation, ...]
    where: Condition | None = None
    group: tuple[Expr, ...] = ()
    having: Condition | None = None
    order: tuple[OrderKey, ...] = ()


@dataclass(frozen=True)
class SetOperation:
    op: str
    left: Query
    right: Query


Query = Select | SetOperation


@dataclass(frozen=True)
class Command:
    """A dot command of the shell."""

    name: str
    argument: str | None


def aggregates(expr: Expr) -> list[Aggregate]:
    match expr:
        case Aggregate():
            return [expr]
        case Arithmetic(_, left, right):
            return aggregates(left) + aggregates(right)
    return []


def condition_aggregates(condition: Condition | None) -> list[Aggregate]:
    match condition:
        case Comparison(_, left, right):
            return aggregates(left) + aggregates(right)
        case Logical(_, left, right):
            return condition_aggregates(left) + condition_aggregates(right)
        case Membership(value):
            return aggregates(value)
    return []


def children(node) -> Iterator:
    """The nodes right below a node, or those in a tuple of nodes."""
    if isinstance(node, tuple):
        yield from node
    elif is_dataclass(node):
        for f in fields(node):
            value = getattr(node, f.name)
            yield from value if isinstance(value, tuple) else (value,)


def queries(node) -> Iterator[Query]:
    """The queries in FROM and the operands of UNION and MINUS, from the outermost inwards."""
    for child in children(node):
        if isinstance(child, Select | SetOperation) and isinstance(node, Relation | SetOperation):
            yield child
        yield from queries(child)
