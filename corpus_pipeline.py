"""The training-corpus pipeline: each stage's result is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import decontaminate, pfair_mix, quality_rules, shard_tree, simhash_dedup
from codestrata.llm.common import checkpoint_dir, delete_folder, read_table

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality_rules.good_documents(docs, quality_rules.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles agree by 0.8 or more) stays: SimHash fingerprints meet in
    deletion variants, minima find what is farther apart in bits, and each link is held against the sets."""
    return simhash_dedup.one_of_each(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of sources below their target weight as often as the weight asks for, in the mixture's order."""
    return pfair_mix.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document, by the hash tree."""
    return shard_tree.assign_shards(docs, shard_tree.hash_tree(SHARDS))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: A fitted model and groups of near-duplicates cannot be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes when the next one's is written; that of the last but one, from which
    the rows are read whenever they are asked for, stays until the application's checkpoint folder is cleared.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = posixpath.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    before = None
    for name, stage in STAGES[:-1]:
        table = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(table)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(table), table
    return STAGES[-1][1](spark, docs, sf_dir)
