"""Inputs of the operators, derived from the driver tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(col):
    return F.split(F.trim(col), r"\s+")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, summary): the summary is the first 40 % of the words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    w = words(F.col("source"))
    return d.withColumn("summary", F.array_join(F.slice(w, 1, F.greatest(F.lit(1), F.floor(F.size(w) * 0.4).cast("int"))), " "))


PAIRS = r"""pairs AS (
  SELECT doc_id, text AS source, array_to_string(w[1 : greatest(1, CAST(floor(len(w) * 0.4) AS INTEGER))], ' ') AS summary
  FROM (SELECT doc_id, text, regexp_split_to_array(trim(text), '\s+') AS w FROM documents))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_index, content, parent_id, section): a chunk is a line of a document that is not blank."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("chunk_index", "content"))
    section = F.floor(F.col("chunk_index") / 8).cast("int")
    return d.select("doc_id", "chunk_index", "content", F.concat_ws("-", "doc_id", section).alias("parent_id"), section.alias("section"))


CHUNKS = r"""chunks AS (
  SELECT doc_id, chunk_index, content, doc_id || '-' || (chunk_index // 8) AS parent_id, CAST(chunk_index // 8 AS INTEGER) AS section
  FROM (SELECT doc_id, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS chunk_index
        FROM (SELECT doc_id, trim(l[i]) AS content, i AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i))
        WHERE content <> ''))"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the first six words of each benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words(F.col("text")), 1, 6), " ").alias("query"))


QUERY_ROWS = r"""queries AS (SELECT item_id AS query_id, array_to_string((regexp_split_to_array(trim(text), '\s+'))[1:6], ' ') AS query FROM benchmark)"""
