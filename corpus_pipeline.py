"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontam, minhash, mixing, queries, shard, toxicity
from sparkloom.llm.common import read, shared_table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it learns from the stage's own documents."""
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")), out="__toxicity")
    return scored.where("__toxicity < 0.5").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes once for each epoch that it is in."""
    return mixing.repeated(docs, **queries.MIX)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with the shard of each row."""
    return shard.with_shards(docs, queries.SHARDS)


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_copies), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: A trained network has no SQL; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
