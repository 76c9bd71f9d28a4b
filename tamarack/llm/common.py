"""Helpers shared by the corpus operators: column picking, shared storage, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(df, text="body")`` is column ``body`` under the name ``text``, and nothing else.

    Columns are found by exact name and position, so further columns whose names differ only in
    case, or that occur twice, do not make the reference ambiguous (the first exact match counts).
    """
    names = df.columns
    for source in columns.values():
        if source not in names:
            raise ValueError(f"no column {source!r} in {names}")
    return numbered(df).select(*(F.col(f"_c{names.index(source)}").alias(target) for target, source in columns.items()))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place, so that names which clash don't matter."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


def passed_through(df: DataFrame, run: Callable) -> DataFrame:
    """``df`` with its columns as they are, after ``run`` over Arrow batches of them all."""
    plain = numbered(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one only where the session names none and runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the machines share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tamarack-')}")
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tamarack/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what :func:`stored` wrote, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that a Python worker has done with back to the machine: workers outlive tasks, and
    an executor has several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and the len + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def row_groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, or one longer row; every row is in one run."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, end
        start = end
