"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm import decontaminate, jaccard, language, mixing, sharding
from quillgate.llm.shared import Scratch, release, remove, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go."""
    return language.confident(docs, language.train(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays, once where its row is repeated; `jaccard.one_of_each` states what
    holds for several texts of one doc_id, nulls, wordless texts and empty tables."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, documents repeated or cut as the blocks say."""
    return mixing.mixed_documents(docs)


def sharding_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return sharding.shard_rows(docs).withColumn("grown_shard", F.lit(None).cast("int"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("sharding", sharding_rows),
]

#: Similarity joins, latent retrieval and seeded hashes can't be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`. A stage's intermediate tables, and the result before it, are deleted once its own result is
    stored; the last stored one stays, as the returned frame reads from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with Scratch(spark) as scratch:
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if before:
            remove(spark, before)
        before = scratch.kept
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
