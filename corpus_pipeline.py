"""From raw documents to training shards: toxicity, near duplicates, benchmark leaks, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared
folder and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import decontam, mixing, sharding, simhash, toxicity
from docflow.llm.common import drop, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate class."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes their words, up to three times, none to leave out."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document that the mixture holds."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Only its table stays: the others are deleted once the next stage is written."""
    docs = raw = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        given, docs = docs, settle(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if given is not raw:
            drop(given)
    return docs
