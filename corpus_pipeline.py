"""A training corpus from documents, in five stages; each is written, and read again by the next.

1. toxicity: documents that the positive-unlabelled model rejects go;
2. near_dedup: of documents that are linked as near copies, the one with the smallest id stays;
3. substring_dedup: words covered by a 35-word window that occurs elsewhere are cut out of the texts;
4. decontaminate: documents that hold a benchmark item, or a part of one, go;
5. byte_bpe: ids of what is left, their offsets and number, and digests of the ids and of the bytes they decode to.

All stages but the last return the columns of documents. Rows with a null id or text pass the
filters that can't judge them. An id that occurs in several rows is one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import bpe, decontaminate, fmindex, minhash, toxicity
from tamarack.llm.common import stored


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fmindex.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: SQL can't express training, hashing and the tokenizer; the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
