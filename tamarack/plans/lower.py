"""Queries as DataFrames.

Every relation's columns get names of their own, so that joins and correlation can't confuse them;
the names that a statement gives come back at the end. What is built are joins, filters,
aggregates and sorts of the public API: pushing filters down, pruning columns, forming equi-joins out
of products and choosing how to join are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.errors import SemanticError
from tamarack.functions import expressions as ex
from tamarack.functions.expressions import Typed
from tamarack.operators import grouping, membership, relations, setops
from tamarack.plans import ast
from tamarack.sources.catalog import Catalog


@dataclass
class Scope:
    """The columns in reach, (alias, name, unique name), those of the queries around it further out."""

    columns: list[tuple[str, str, str]]
    kinds: dict[str, str]
    outer: Scope | None = None
    aliases: dict[str, ast.Expr] = field(default_factory=dict)

    def find(self, name: ast.Name, aliases: bool = False) -> ast.Expr:
        scope, depth = self, 0
        while scope:
            if depth == 0 and aliases and not name.table and name.column in self.aliases:
                return self.aliases[name.column]
            for alias, column, unique in scope.columns:
                if column == name.column and name.table in ("", alias):
                    return ast.Ref(unique, depth)
            scope, depth = scope.outer, depth + 1
        raise SemanticError(f"no such column: {name.table + '.' if name.table else ''}{name.column}")

    def kind(self, ref: ast.Ref) -> str:
        scope = self
        for _ in range(ref.depth):
            scope = scope.outer
        return scope.kinds[ref.column]


@dataclass
class Result:
    """``frame`` has the unique columns ``columns`` of ``kinds``; ``names`` are those that the statement gives
    them. A frame that refers outside can't be asked for its columns itself."""

    frame: DataFrame
    names: list[str]
    columns: list[str]
    kinds: list[str]


@dataclass
class Domain:
    """The distinct values, in ``frame``, of what a subquery uses of the queries around it. A query lowered
    over a domain computes its rows for each of them, and its frame has the domain's columns too."""

    frame: DataFrame
    columns: list[tuple[str, str, str]]
    kinds: dict[str, str]

    @property
    def names(self) -> list[str]:
        return self.frame.columns


class Lowering:
    def __init__(self, catalog: Catalog, minus: str = "all", hint: str | None = None):
        self.catalog, self.minus, self.hint, self.numbers = catalog, minus, hint, itertools.count(1)
        self.repeated: set[ast.Query] = set()
        self.shared: dict[ast.Query, Result] = {}

    def statement(self, query: ast.Query, share: bool = False) -> Result:
        """``share``: subqueries in FROM and operands that the statement repeats are computed once and kept."""
        if share:
            every = list(ast.queries(query))
            self.repeated = {q for q in every if every.count(q) > 1 and not self.escaping(q)}
        return self.query(query)

    def query(self, query: ast.Query, outer: Scope | None = None, domain: Domain | None = None) -> Result:
        if domain is None and query in self.repeated:
            if query not in self.shared:
                result = self.lowered(query, None, None)
                self.shared[query] = replace(result, frame=self.catalog.keep(result.frame))
            kept = self.shared[query]
            unique = [f"k{next(self.numbers)}" for _ in kept.columns]
            return Result(kept.frame.toDF(*unique), kept.names, unique, kept.kinds)
        return self.lowered(query, outer, domain)

    def lowered(self, query: ast.Query, outer: Scope | None, domain: Domain | None) -> Result:
        if isinstance(query, ast.SetOperation):
            left, right = self.query(query.left, outer, domain), self.query(query.right, outer, domain)
            if len(left.names) != len(right.names):
                raise SemanticError(f"{query.op.upper()} of {len(left.names)} and {len(right.names)} columns")
            unique = [f"u{next(self.numbers)}" for _ in left.names]
            op = setops.union if query.op == "union" else setops.minus_distinct if self.minus == "distinct" else setops.minus
            every = [*(domain.names if domain else ()), *unique]
            frame = op(left.frame.toDF(*every), right.frame.toDF(*every))
            kinds = {f.name: ex.kind_of(f.dataType) for f in frame.schema.fields}
            return Result(frame, left.names, unique, [kinds[u] for u in unique])
        return self.select(query, outer, domain)

    # what a query uses of those around it

    def offered(self, query: ast.Query) -> list[str]:
        """The names of a query's columns."""
        if isinstance(query, ast.SetOperation):
            return self.offered(query.left)
        return [i.alias or (i.expr.column if isinstance(i.expr, ast.Name) else "") for i in query.items] or [c for _, c in self.own(query)]

    def own(self, query: ast.Select) -> list[tuple[str, str]]:
        return [(r.alias, c) for r in query.relations for c in (self.catalog.table(r.source).columns if isinstance(r.source, str) else self.offered(r.source))]

    def escaping(self, query: ast.Query) -> set[ast.Name]:
        """The names in a query, or in queries within it, that none of its relations offers."""
        if isinstance(query, ast.SetOperation):
            return self.escaping(query.left) | self.escaping(query.right)
        own, aliases = self.own(query), {i.alias for i in query.items if i.alias}
        mine = lambda n: any(c == n.column and n.table in ("", a) for a, c in own)
        free = {n for part in (query.items, query.where) for n in self.names(part) if not mine(n)}
        free |= {n for part in (query.group, query.having, query.order) for n in self.names(part) if not mine(n) and (n.table or n.column not in aliases)}
        return free.union(*(self.escaping(r.source) for r in query.relations if not isinstance(r.source, str)))

    def names(self, node) -> set[ast.Name]:
        match node:
            case ast.Name():
                return {node}
            case ast.Select() | ast.SetOperation():
                return self.escaping(node)
        return set().union(*(self.names(n) for n in ast.children(node)))

    def needs_domain(self, query: ast.Select) -> bool:
        """Whether the query refers outside in a way that Spark's subqueries don't resolve."""
        if not self.escaping(query):
            return False
        grouped = query.group or query.having or any(ast.aggregates(i.expr) for i in query.items)
        return bool(grouped) or any(self.escaping(r.source) for r in query.relations if not isinstance(r.source, str))

    # the relations of a FROM clause

    def sources(self, query: ast.Select, outer: Scope | None, domain: Domain | None = None) -> tuple[DataFrame, Scope, list[str]]:
        """The product of the relations, what it offers, and the columns that number its rows if asked for.
        Over a domain its columns are offered behind the relations' own, and rows are numbered before they meet it."""
        frames, columns, kinds = [], [], {}
        bound: list[list[str]] = []  # each frame's copies of the domain's columns
        seen: set[str] = set()
        for relation in query.relations:
            if relation.alias in seen:
                raise SemanticError(f"the alias {relation.alias} is given twice")
            seen.add(relation.alias)
            number = next(self.numbers)
            if isinstance(relation.source, str):
                frame = self.catalog.table(relation.source)
                names, own = frame.columns, [ex.kind_of(f.dataType) for f in frame.schema.fields]
                unique = [f"t{number}_{i}" for i in range(len(names))]
                frame = frame.toDF(*unique)
                bound.append([])
            else:
                inner = domain if domain and self.escaping(relation.source) else None
                result = self.query(relation.source, outer, inner)
                names, own = result.names, result.kinds
                unique = [f"t{number}_{i}" for i in range(len(names))]
                bound.append([f"t{number}_{n}" for n in inner.names] if inner else [])
                copies = zip(inner.names, bound[-1], strict=True) if inner else ()
                frame = result.frame.select(*(F.col(c).alias(u) for c, u in [*zip(result.columns, unique, strict=True), *copies]))
            if self.hint and frames:
                frame = frame.hint(self.hint)
            frames.append(frame)
            columns += [(relation.alias, name, u) for name, u in zip(names, unique, strict=True)]
            kinds |= dict(zip(unique, own, strict=True))
        scope = Scope(columns, kinds, outer)
        numbers: list[str] = []
        if grouping.needs_row_numbers(query):
            numbers = [f"r{next(self.numbers)}" for _ in frames]
        if len(numbers) > 1 or domain:
            frames = [_numbered(f, n) for f, n in zip(frames, numbers, strict=True)] if numbers else frames
        if domain is None:
            return relations.product(frames), scope, numbers
        scope.columns, scope.kinds = columns + domain.columns, kinds | domain.kinds
        return relations.bound_product(domain.frame, frames, bound), scope, numbers

    # resolution

    def resolve(self, expr: ast.Expr, scope: Scope, aliases: bool = False) -> ast.Expr:
        match expr:
            case ast.Name():
                return scope.find(expr, aliases)
            case ast.Arithmetic(op, left, right):
                return ast.Arithmetic(op, self.resolve(left, scope, aliases), self.resolve(right, scope, aliases))
            case ast.Aggregate(function, argument):
                return ast.Aggregate(function, argument and self.resolve(argument, scope))
        return expr

    def resolve_condition(self, condition: ast.Condition, scope: Scope, aliases: bool = False) -> ast.Condition:
        match condition:
            case ast.Comparison(op, left, right):
                return ast.Comparison(op, self.resolve(left, scope, aliases), self.resolve(right, scope, aliases))
            case ast.Logical(op, left, right):
                return ast.Logical(op, self.resolve_condition(left, scope, aliases), self.resolve_condition(right, scope, aliases))
        return replace(condition, value=self.resolve(condition.value, scope, aliases))

    # expressions and conditions over a frame

    def value(self, expr: ast.Expr, scope: Scope, known: dict[ast.Expr, Typed] | None = None) -> Typed:
        if known is not None and expr in known:
            return known[expr]
        match expr:
            case ast.Number(value) | ast.Text(value):
                return ex.literal(value)
            case ast.Ref(column, depth):
                if depth > 1:
                    raise _TooDeep
                return Typed(F.col(column).outer() if depth else F.col(column), scope.kind(expr))
            case ast.Arithmetic(op, left, right):
                return ex.arithmetic(op, self.value(left, scope, known), self.value(right, scope, known))
        raise SemanticError("an aggregate can't be used here")

    def condition(self, frame: DataFrame, condition: ast.Condition, scope: Scope, known: dict[ast.Expr, Typed] | None = None) -> tuple[DataFrame, Column]:
        """The condition as a column of the frame, to which memberships may have joined a mark."""
        match condition:
            case ast.Comparison(op, left, right):
                return frame, ex.comparison(op, self.value(left, scope, known), self.value(right, scope, known))
            case ast.Logical(op, left, right):
                frame, a = self.condition(frame, left, scope, known)
                frame, b = self.condition(frame, right, scope, known)
                return frame, (a & b if op == "and" else a | b)
        return self.member(frame, condition, scope, known)

    def filtered(self, frame: DataFrame, condition: ast.Condition | None, scope: Scope, known: dict[ast.Expr, Typed] | None = None) -> DataFrame:
        if condition is None:
            return frame
        marked, column = self.condition(frame, condition, scope, known)
        return frame.where(column) if marked is frame else marked.where(column).select(*frame.columns)

    def member(self, frame: DataFrame, test: ast.Membership, scope: Scope, known) -> tuple[DataFrame, Column]:
        """A union holds a value that either side holds; a difference one that only its left side does."""
        query = test.query
        if isinstance(query, ast.SetOperation):
            frame, a = self.member(frame, replace(test, query=query.left, negated=False), scope, known)
            frame, b = self.member(frame, replace(test, query=query.right, negated=False), scope, known)
            found = a | b if query.op == "union" else a & ~b
            return frame, (~found if test.negated else found)
        value = self.value(test.value, scope, known)
        try:
            if self.needs_domain(query):
                raise _TooDeep
            found = self.exists(query, scope, value, test.value if known is None else None)
        except _TooDeep:
            if scope.outer is not None:
                raise  # the outermost query brings the references nearer
            frame, found = self.joined(frame, query, scope, value, known)
        return frame, (~found if test.negated else found)

    def exists(self, query: ast.Select, scope: Scope, value: Typed, expr: ast.Expr | None) -> Column:
        """A semi-join or anti-join, or a mark under OR, as Catalyst sees fit. ``expr`` is the value
        where that is made of the scope's columns, None where of groups."""
        if expr is None:
            raise _TooDeep
        result = self.select(query, scope)
        inner = self.single(result)
        outside = Typed(_outer(self, expr, scope), value.kind)
        return result.frame.where(ex.comparison("=", inner, outside)).exists()

    def single(self, result: Result) -> Typed:
        if len(result.names) != 1:
            raise SemanticError(f"IN takes a query of one column, not {len(result.names)}")
        return Typed(F.col(result.columns[0]), result.kinds[0])

    def joined(self, frame: DataFrame, query: ast.Select, scope: Scope, value: Typed, known: dict[ast.Expr, Typed] | None) -> tuple[DataFrame, Column]:
        """For queries that refer outside in ways that Spark's subqueries don't have: the distinct values of
        what the query uses of this frame, and of what it is asked for, are joined with its relations."""
        used, kinds = {}, {}
        for name in sorted(self.escaping(query), key=lambda n: (n.table, n.column)):
            ref = scope.find(name)
            typed = self.value(ref, scope, known)
            alias = next(a for a, _, u in scope.columns if u == ref.column)
            used.setdefault(ref.column, (alias, name.column, f"o{next(self.numbers)}", typed))
        probe = f"p{next(self.numbers)}"
        copies = [copy for _, _, copy, _ in used.values()]
        kinds = {copy: typed.kind for _, _, copy, typed in used.values()} | {probe: value.kind}
        outside = frame.select(*(typed.column.alias(copy) for _, _, copy, typed in used.values()), value.column.alias(probe)).distinct()
        columns = [(alias, column, copy) for alias, column, copy, _ in used.values()]
        result = self.select(query, None, Domain(outside, columns, kinds))
        inside = self.single(result)
        hits = result.frame.where(ex.comparison("=", inside, Typed(F.col(probe), value.kind))).select(*copies, probe).distinct()
        mine = [typed.column for _, _, _, typed in used.values()]
        return membership.marked(frame, [*mine, value.column], hits, f"m{next(self.numbers)}")

    def wanted_within(self, condition: ast.Condition | None, scope: Scope) -> list[ast.Ref]:
        """The columns of this scope that queries within the condition refer to."""
        match condition:
            case ast.Logical(_, left, right):
                return self.wanted_within(left, scope) + self.wanted_within(right, scope)
            case ast.Membership(_, query):
                refs = (scope.find(n) for n in sorted(self.escaping(query), key=lambda n: (n.table, n.column)))
                return [r for r in refs if r.depth == 0]
        return []

    # one SELECT

    def select(self, query: ast.Select, outer: Scope | None, domain: Domain | None = None) -> Result:
        frame, scope, row_numbers = self.sources(query, outer, domain)
        carried = {ast.Ref(n): Typed(F.col(n), domain.kinds[n]) for n in domain.names} if domain else {}
        if query.where:
            if ast.condition_aggregates(query.where):
                raise SemanticError("WHERE can't have aggregates")
            frame = self.filtered(frame, self.resolve_condition(query.where, scope), scope)
        if len(row_numbers) == 1 and not domain:  # behind the filter, which so reaches the scan
            frame = _numbered(frame, row_numbers[0])
        items, names = [], []
        fresh = itertools.count(1)
        for item in query.items or tuple(ast.Item(ast.Name(a, n), None) for a, n, u in scope.columns if ast.Ref(u) not in carried):
            expr = self.resolve(item.expr, scope)
            if item.alias:
                name = item.alias
            elif isinstance(item.expr, ast.Name):
                name = item.expr.column
            else:
                name = f"{next(fresh)}{'_agg' if isinstance(item.expr, ast.Aggregate) else ''}"
            items.append(expr)
            names.append(name)
            if item.alias:
                scope.aliases.setdefault(item.alias, expr)
        having = query.having and self.resolve_condition(query.having, scope, aliases=True)
        order = [replace(k, expr=self.resolve(k.expr, scope, aliases=True)) for k in query.order]
        keys = [self.resolve(g, scope, aliases=True) for g in query.group]
        known = None
        wanted = [a for e in [*items, *(k.expr for k in order)] for a in ast.aggregates(e)] + ast.condition_aggregates(having)
        if query.group or wanted or having:
            if any(ast.aggregates(k) for k in keys):
                raise SemanticError("GROUP BY can't have aggregates")
            used = grouping.references([*items, *(k.expr for k in order)], having, [*keys, *carried])
            used += [r for r in self.wanted_within(having, scope) if r not in [*used, *keys, *carried]]
            frame, known = grouping.grouped(
                frame,
                carried | {k: self.value(k, scope) for k in keys},
                {a: ex.aggregate(a.function, a.argument and self.value(a.argument, scope)) for a in wanted},
                {r: self.value(r, scope) for r in used},
                row_numbers,
                lambda: f"g{next(self.numbers)}",
            )
            if carried:
                frame, known = grouping.over_domain(frame, known, carried, domain.frame if not query.group else None, wanted)
            frame = self.filtered(frame, having, scope, known)
        if order and not domain:
            sort = [self.value(k.expr, scope, known).column for k in order]
            frame = frame.orderBy(*(c.desc() if k.descending else c.asc() for c, k in zip(sort, order, strict=True)))
        values = [self.value(e, scope, known) for e in items]
        unique = [f"s{next(self.numbers)}" for _ in items]
        out = frame.select(*(domain.names if domain else ()), *(v.column.alias(u) for v, u in zip(values, unique, strict=True)))
        return Result(out, names, unique, [v.kind for v in values])


def _numbered(frame: DataFrame, name: str) -> DataFrame:
    """The frame with a column that orders its rows as they were read: by file, place in the file, and
    row; only by row where it isn't read from files."""
    row = F.monotonically_increasing_id()
    try:
        return frame.withColumn(name, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), row.alias("row")))
    except AnalysisException:
        return frame.withColumn(name, row)


class _TooDeep(Exception):
    """A reference over two levels or more, which Spark's subqueries don't resolve."""


def _outer(lowering: Lowering, expr: ast.Expr, scope: Scope) -> Column:
    """The expression as it looks from a query within: this scope's columns are outer ones."""
    match expr:
        case ast.Ref(column, 0):
            return F.col(column).outer()
        case ast.Ref():
            raise _TooDeep
        case ast.Arithmetic(op, left, right):
            kinds = lowering.value(left, scope).kind, lowering.value(right, scope).kind
            return ex.arithmetic(op, Typed(_outer(lowering, left, scope), kinds[0]), Typed(_outer(lowering, right, scope), kinds[1])).column
    return lowering.value(expr, scope).column
