"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import TextIO

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from tamarack.errors import EngineError, EvaluationError, SemanticError
from tamarack.plans import ast, graph
from tamarack.plans.lower import Lowering
from tamarack.plans.parser import parse
from tamarack.sources import sinks
from tamarack.sources.catalog import Catalog

_PUSH = "org.apache.spark.sql.catalyst.optimizer."
#: The optimizer's rules behind each switch.
_PUSH_DOWN = ("PushDownPredicates", "PushPredicateThroughNonJoin", "PushPredicateThroughJoin", "PushDownLeftSemiAntiJoin")
_PRUNING = ("ColumnPruning",)


@dataclass(frozen=True)
class Options:
    """``big_data``: sort-merge joins instead of broadcasts. ``joins`` off: products stay products.
    ``minus``: "all" keeps the left side's repeated rows, "distinct" doesn't."""

    use_caching: bool = False
    push_down: bool = True
    pruning: bool = True
    joins: bool = True
    big_data: bool = False
    minus: str = "all"


class Engine:
    def __init__(self, spark: SparkSession, base_dir: str = "", options: Options | None = None):
        self.options = options or Options()
        self.spark = self._session(spark)
        self.catalog = Catalog(self.spark, base_dir, self.options.use_caching)

    def _session(self, spark: SparkSession) -> SparkSession:
        """A session of its own where switches ask for other settings."""
        o, out = self.options, [()]
        if not o.push_down:
            out.append(_PUSH_DOWN)
        if not o.pruning:
            out.append(_PRUNING)
        if not o.joins:
            out.append(("PushPredicateThroughJoin", "ReorderJoin"))
        rules = [_PUSH + r for group in out for r in group]
        if not rules and not o.big_data:
            return spark
        own = spark.newSession()
        if rules:
            own.conf.set("spark.sql.optimizer.excludedRules", ",".join(dict.fromkeys(rules)))
        if o.big_data:
            own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        return own

    def sql(self, text: str) -> DataFrame:
        """The statement's result, not yet computed. Names may occur twice, as the statement has them."""
        query = parse(text)
        if isinstance(query, ast.Command):
            raise SemanticError(f"a command of the shell, not a query: .{query.name}")
        return self.lower(query)

    def lower(self, query: ast.Query) -> DataFrame:
        try:
            result = Lowering(self.catalog, self.options.minus, "merge" if self.options.big_data else None).statement(query, self.options.use_caching)
        except AnalysisException as error:
            raise SemanticError(str(error).splitlines()[0]) from error
        return result.frame.toDF(*result.names)

    def register(self, name: str, df: DataFrame) -> None:
        self.catalog.register(name, df)

    def run_file(self, path: str) -> DataFrame:
        with open(path, encoding="utf-8") as f:
            return self.sql(f.read())

    def collect(self, text: str) -> list:
        return _guarded(lambda: self.sql(text).collect())

    def write(self, df: DataFrame, out: TextIO, pretty: bool = False) -> None:
        _guarded(lambda: (sinks.write_pretty if pretty else sinks.write_text)(df, out))

    def save(self, text: str, path: str) -> None:
        """The result as a folder of CSV files, written by the executors."""
        _guarded(lambda: sinks.save(self.sql(text), path))

    def explain(self, text: str, mode: str = "formatted") -> str:
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def to_dot(self, text: str, optimized: bool = True) -> str:
        """The tree of the statement's operators after the optimizer's passes, or the statement's own tree."""
        query = parse(text)
        if not optimized or isinstance(query, ast.Command):
            return graph.dot(query)
        return graph.plan_dot(self.lower(query)._jdf.queryExecution().optimizedPlan())

    def release(self) -> None:
        """Let go of the tables and shared subqueries that ``use_caching`` keeps."""
        self.catalog.release()

    def change_dir(self, path: str) -> str:
        self.catalog.base_dir = os.path.normpath(os.path.join(self.catalog.base_dir or os.getcwd(), path))
        return self.catalog.base_dir


def _guarded(run):
    """Failures that the data cause, as the engine's own errors."""
    try:
        return run()
    except EngineError:
        raise
    except PySparkException as error:
        raise EvaluationError(str(error).splitlines()[0]) from error
