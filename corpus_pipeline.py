"""The corpus pipeline: documents through five of the operators, stage by stage.

toxicity drops documents that the pattern grammar rejects; near-duplicates keeps
one document of each group; decontamination drops documents that hold a benchmark
passage; mixing draws documents so that token shares meet their targets; sharding
gives every document left its shard and slot. All but the last return the
columns of ``documents``.

An empty or null text has the base score, no near copies, no leaks and no tokens
and passes every filter; extra columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from examlytics.llm import latent_decontamination, mixing, ngram_join, sharding, toxicity
from examlytics.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, grammar)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return latent_decontamination.remove_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: A trained score and sampled splitters cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
