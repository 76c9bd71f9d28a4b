"""Tables by path or name.

``x.csv`` is a comma-separated file with a header line, ``x.parquet`` a Parquet table, and any other
name the Parquet table, or else the CSV file, of that name. Relative paths start at the base folder.
The CSV form knows no nulls: empty cells are empty texts. Cells are stripped of blanks. A CSV
column is BIGINT if all of its cells are whole numbers that fit, otherwise text. A quoted cell may
hold line ends; a row with more or fewer cells than the header is an error.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.errors import EvaluationError, SemanticError

_WHOLE = r"^-?[0-9]+$"


class Catalog:
    def __init__(self, spark: SparkSession, base_dir: str = "", cache: bool = False):
        self.spark, self.base_dir, self.cache = spark, base_dir, cache
        self.known: dict[str, DataFrame] = {}
        self.kept: list[DataFrame] = []

    def path(self, name: str) -> str:
        if not self.base_dir or name.startswith("/") or "://" in name:
            return name
        return f"{self.base_dir.rstrip('/')}/{name}"

    def register(self, name: str, df: DataFrame) -> None:
        """Make ``df`` the table of that name; a streaming one too."""
        self.known[name] = df

    def table(self, name: str) -> DataFrame:
        key = name if name in self.known else self.path(name)
        if key not in self.known:
            df = self._read(name, key)
            self.known[key] = self.keep(df) if self.cache else df
        return self.known[key]

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, kept once it is computed, until :meth:`release`."""
        self.kept.append(df.persist())
        return self.kept[-1]

    def release(self) -> None:
        """Let go of all that was kept; tables are looked up anew."""
        for df in self.kept:
            df.unpersist()
        self.known = {k: df for k, df in self.known.items() if not any(df is x for x in self.kept)}
        self.kept.clear()

    def _read(self, name: str, path: str) -> DataFrame:
        tried = [path] if name.lower().endswith((".csv", ".parquet")) else [f"{path}.parquet", f"{path}.csv"]
        for place in tried:
            try:
                return read_csv(self.spark, place) if place.lower().endswith(".csv") else self.spark.read.parquet(place)
            except AnalysisException as error:
                if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        raise SemanticError(f"no such table: {name}")


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, so that a cell may go on behind it."""
    lines = spark.read.text(path).where(F.col("value").contains('"'))
    return not lines.where((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One pass over the rows settles the types; the table itself is read lazily. Files are read in
    splits, as a whole only where :func:`_spans_lines` says that line ends may be parts of cells."""
    options = {"header": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "quote": '"', "escape": '"', "emptyValue": "", "multiLine": _spans_lines(spark, path)}
    raw = spark.read.options(**options, mode="PERMISSIVE").csv(path)
    if not raw.columns:
        return raw
    # every column is read here, so that a row of another length shows
    strict = spark.read.options(**options, mode="FAILFAST", enforceSchema=True).schema(raw.schema).csv(path).na.fill("")
    plain = strict.toDF(*(f"c{i}" for i in range(len(raw.columns))))
    whole = [F.bool_and(F.col(c).rlike(_WHOLE) & F.expr(f"try_cast({c} AS BIGINT)").isNotNull()).alias(c) for c in plain.columns]
    try:
        is_whole = plain.agg(*whole).first()
    except (PySparkException, Py4JJavaError) as error:
        if "MALFORMED" not in str(error):
            raise
        raise EvaluationError(f"a row of {path} has more or fewer cells than its header") from error
    plain = raw.na.fill("").toDF(*plain.columns)
    typed = [F.col(c).cast("bigint").alias(name) if is_whole[c] else F.col(c).alias(name) for c, name in zip(plain.columns, raw.columns, strict=True)]
    return plain.select(*typed)
