"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; its result
is written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents``; the last returns shard assignments.
Nulls, empty texts, repeated rows and extra columns are treated as each
operator's docstring says; an empty table goes through all stages as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontam, mixture, neardup, shards, toxicity
from weft.session import stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or classifier does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the least id."""
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of documents that bring sources to their target weights, repeats as rows."""
    return mixture.take(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and its slot there."""
    return shards.assign(docs).drop("text_key")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

# Trained scores and hashed fingerprints are beyond SQL; a test holds run() against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tag = uuid.uuid4().hex[:8]
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{tag}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
