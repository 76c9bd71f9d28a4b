"""GROUP BY and aggregates.

Columns that are neither grouped by nor aggregated have the value of the group's last row in the
order of the input; only then are rows numbered, at the scans.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.expressions import Typed
from tamarack.plans import ast


def needs_row_numbers(query: ast.Select) -> bool:
    """Whether the query groups and may use columns as they are in the last row."""
    if not (query.group or any(ast.aggregates(i.expr) for i in query.items) or ast.condition_aggregates(query.having)):
        return False
    keys = set(query.group)
    bare = {k.column for k in keys if isinstance(k, ast.Name)}

    def free(expr: ast.Expr) -> bool:
        if expr in keys or isinstance(expr, ast.Aggregate):
            return False
        if isinstance(expr, ast.Arithmetic):
            return free(expr.left) or free(expr.right)
        return isinstance(expr, ast.Name) and expr.column not in bare

    return not query.items or any(free(i.expr) for i in query.items) or bool(query.having or query.order)


def references(exprs: list[ast.Expr], having: ast.Condition | None, keys: list[ast.Expr]) -> list[ast.Ref]:
    """The columns that are used outside of aggregates and keys."""
    out: dict[ast.Ref, None] = {}

    def walk(node) -> None:
        if node in keys:
            return
        match node:
            case ast.Ref(_, 0):
                out[node] = None
            case ast.Arithmetic(_, left, right) | ast.Comparison(_, left, right) | ast.Logical(_, left, right):
                walk(left)
                walk(right)
            case ast.Membership(value):
                walk(value)

    for e in exprs:
        walk(e)
    if having is not None:
        walk(having)
    return list(out)


def grouped(frame: DataFrame, keys: dict[ast.Expr, Typed], aggregates: dict[ast.Expr, Typed], free: dict[ast.Expr, Typed], numbers: list[str], fresh: Callable[[], str]) -> tuple[DataFrame, dict[ast.Expr, Typed]]:
    """The groups, and where each key, aggregate and free column is in them."""
    known: dict[ast.Expr, Typed] = {}

    def named(typed: dict[ast.Expr, Typed]):
        columns = []
        for expr, t in typed.items():
            name = fresh()
            columns.append(t.column.alias(name))
            known[expr] = Typed(F.col(name), t.kind)
        return columns

    by, measures = named(keys), named(aggregates)
    if free:
        last = fresh()
        inner = {expr: fresh() for expr in free}
        row = F.struct(*(t.column.alias(inner[e]) for e, t in free.items()))
        measures.append(F.max_by(row, F.struct(*numbers)).alias(last))
        known |= {e: Typed(F.col(last)[inner[e]], t.kind) for e, t in free.items()}
    if not measures:
        return frame.select(*by).distinct(), known
    return frame.groupBy(*by).agg(*measures), known


def over_domain(frame: DataFrame, known: dict[ast.Expr, Typed], carried: dict[ast.Expr, Typed], whole: DataFrame | None, aggregates: list[ast.Expr]) -> tuple[DataFrame, dict[ast.Expr, Typed]]:
    """Groups by a domain's columns among others, with these under their own names again. With ``whole``,
    the domain, each of its rows has a group, as aggregates without GROUP BY have one over no rows."""
    again = {expr: t.column for expr, t in known.items() if expr in carried}
    held = frame.select(*(c.alias(f"{expr.column}_d") for expr, c in again.items()), *(c for c in frame.columns))
    if whole is None:
        out = held.withColumnsRenamed({f"{e.column}_d": e.column for e in carried})
    else:
        same = functools.reduce(lambda x, y: x & y, (F.col(e.column).eqNullSafe(F.col(f"{e.column}_d")) for e in carried))
        out = whole.join(held, same, "left").drop(*(f"{e.column}_d" for e in carried))
    counts = {a for a in aggregates if isinstance(a, ast.Aggregate) and a.function == "count"}
    filled = {a: Typed(F.coalesce(known[a].column, F.lit(0).cast("bigint")), known[a].kind) for a in counts}
    return out, known | filled | carried
