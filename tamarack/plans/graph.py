"""A statement's tree, or its optimized plan, as a graph in the DOT language."""

from __future__ import annotations

import dataclasses
import itertools

from tamarack.plans import ast


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ")


def _label(node) -> str:
    plain = [str(v) for f in dataclasses.fields(node) if isinstance(v := getattr(node, f.name), str | int | bool) and v != ""]
    return _escaped(" ".join([type(node).__name__, *plain]))


def dot(query: ast.Query | ast.Command) -> str:
    numbers, lines = itertools.count(), ["digraph statement {", "  node [shape=box];"]

    def walk(node) -> int:
        own = next(numbers)
        lines.append(f'  n{own} [label="{_label(node)}"];')
        for f in dataclasses.fields(node):
            value = getattr(node, f.name)
            for child in value if isinstance(value, tuple) else (value,):
                if dataclasses.is_dataclass(child):
                    lines.append(f'  n{own} -> n{walk(child)} [label="{f.name}"];')
        return own

    walk(query)
    return "\n".join([*lines, "}"]) + "\n"


#: Fields of an operator that its label shows.
SHOWN = 60


def plan_dot(plan) -> str:
    """The graph of a logical plan of Spark's, which is walked on the driver."""
    numbers, lines = itertools.count(), ["digraph plan {", "  node [shape=box];"]

    def walk(node) -> int:
        own = next(numbers)
        lines.append(f'  n{own} [label="{_escaped(node.simpleString(SHOWN))}"];')
        below = node.children()
        for i in range(below.size()):
            lines.append(f"  n{own} -> n{walk(below.apply(i))};")
        return own

    walk(plan)
    return "\n".join([*lines, "}"]) + "\n"
