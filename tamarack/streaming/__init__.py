"""Statements over growing folders.

A statement lowers to DataFrame operations, so a table may as well be a stream of files: filters,
computed columns and joins with static tables run as they are, micro-batch by micro-batch.
"""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from tamarack.engine import Engine


def follow(engine: Engine, statement: str, table: str, source: str, target: str, state: str, continuous: bool = False) -> StreamingQuery:
    """Run ``statement`` over ``table``, the Parquet files that arrive in ``source``, into Parquet files in
    ``target``. ``state`` keeps how far it has come; without ``continuous`` it ends with what is there."""
    schema = engine.spark.read.parquet(source).schema
    engine.register(table, engine.spark.readStream.schema(schema).parquet(source))
    writer = engine.sql(statement).writeStream.format("parquet").option("checkpointLocation", state)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start(target)
