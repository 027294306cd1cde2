"""Context packing of many queries at once: passages -> deduplicated, merged, cut to a budget, cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import est_tokens, overlap, strip, token_set

# Similarity of repeats, tokens a citation costs.
DEDUP_AT, CITATION_TOKENS = 0.85, 8


def normalize_passages(df: DataFrame) -> DataFrame:
    """CTX1: defaults for missing ids, scores and ranks; passages without content go."""
    df = df.filter(F.coalesce("content", F.lit("")) != "")
    return df.select("query_id", F.coalesce(F.col("chunk_id").cast("string"), F.concat(F.lit("anon_"), F.col("rank"))).alias("chunk_id"), "content", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("rank", F.lit(0)).cast("int").alias("rank"), F.col("parent_id").cast("string"), "section_path")


def _items(with_tokens: bool) -> Column:
    own = F.struct((-F.col("score")).alias("key"), "rank", "chunk_id", "content", "score", "parent_id", "section_path", *([token_set("content", "word").alias("terms")] if with_tokens else []))
    return F.array_sort(F.collect_list(own))


def dedupe_passages(df: DataFrame, at: float = DEDUP_AT) -> DataFrame:
    """CTX2: greedy by score: a passage goes if it repeats one that was kept (token overlap or equal text).

    One ordered fold for each query over its own candidates, in the JVM.
    """
    g = df.groupBy("query_id").agg(_items(True).alias("items"))

    def like(a, b):
        short = (F.size(a["terms"]) == 0) | (F.size(b["terms"]) == 0)
        same = strip(a["content"]) == strip(b["content"])
        near = F.when(short, (strip(F.lower(a["content"])) == strip(F.lower(b["content"])))).otherwise(overlap(a["terms"], b["terms"]) >= at)
        return same | near

    kind = g.schema["items"].dataType
    kept = F.aggregate("items", F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: like(x, k)), kept).otherwise(F.concat(kept, F.array(x))))
    return g.select("query_id", F.explode(kept).alias("x")).select("query_id", "x.chunk_id", "x.content", "x.score", "x.rank", "x.parent_id", "x.section_path")


def merge_siblings(df: DataFrame) -> DataFrame:
    """CTX3: passages of one parent become one block, in section and rank order; others stand alone."""
    key = F.when(F.coalesce("parent_id", F.lit("")) == "", F.concat(F.lit("solo "), "chunk_id")).otherwise(F.concat(F.lit("parent "), "parent_id"))
    member = F.struct(F.coalesce("section_path", F.lit("")).alias("s"), "rank", "chunk_id", "content", "parent_id", "section_path")
    g = df.groupBy("query_id", key.alias("block")).agg(F.array_sort(F.collect_list(member)).alias("m"), F.max("score").alias("score"), F.min("rank").alias("rank"))
    return g.select("query_id", F.array_join(F.transform("m", lambda x: x["content"]), "\n\n").alias("content"), F.transform("m", lambda x: x["chunk_id"]).alias("chunk_ids"), "score", "rank", F.col("m")[0]["parent_id"].alias("parent_id"), F.col("m")[0]["section_path"].alias("section_path"))


def select_under_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """CTX4: greedy by score, skipping what does not fit; a first block over the budget is cut to it."""
    own = F.struct((-F.col("score")).alias("key"), "rank", "chunk_ids", "content", "score", "parent_id", "section_path", (est_tokens("content") + CITATION_TOKENS).alias("cost"))
    g = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(own)).alias("items"))
    kind = g.schema["items"].dataType
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("kept"), F.lit(False).alias("full"))

    def take(s, x):
        first = F.size(s["kept"]) == 0
        cut = x.withField("content", F.substring(x["content"], 1, max(64, budget * 4)))
        over = s["used"] + x["cost"] > budget
        return (
            F.when(s["full"] | (~first & over), s)
            .when(first & over, F.struct(F.lit(budget).alias("used"), F.array(cut).alias("kept"), F.lit(True).alias("full")))
            .otherwise(F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["kept"], F.array(x)).alias("kept"), F.lit(False).alias("full")))
        )

    out = g.select("query_id", F.explode(F.aggregate("items", start, take)["kept"]).alias("x"))
    return out.select("query_id", "x.content", "x.chunk_ids", "x.score", "x.rank", "x.parent_id", "x.section_path")


def number_citations(blocks: DataFrame) -> DataFrame:
    """Blocks in section order, sections without a path last, numbered from 1."""
    w = Window.partitionBy("query_id").orderBy(F.col("section_path").isNull(), F.coalesce("section_path", F.lit("")), "rank")
    return blocks.withColumn("citation", F.row_number().over(w))


def assemble_context(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CTX5: (query_id, context_text, tokens_used) and provenance rows (query_id, chunk_id, citation, ...)."""
    b = number_citations(blocks)
    part = F.struct("citation", F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("]\n"), "content").alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n\n---\n\n")
    packs = b.groupBy("query_id").agg(text.alias("context_text"))
    packs = packs.withColumn("tokens_used", est_tokens("context_text"))
    return packs, b.select("query_id", F.explode("chunk_ids").alias("chunk_id"), "citation", "score", "rank", "parent_id", "section_path")


def answer_envelopes(provenance: DataFrame, answers: DataFrame) -> DataFrame:
    """CTX6: an answer with its sources, sections, mean relevance as confidence, and gaps where it has none."""
    g = provenance.groupBy("query_id").agg(F.countDistinct("citation").alias("citations"), F.count("*").alias("sources"), F.avg(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias("confidence"), F.array_join(F.array_sort(F.collect_set(F.coalesce("section_path", F.lit("(no section)")))), ", ").alias("sections"))
    out = answers.join(g, "query_id", "left")
    return out.select("query_id", "answer", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("sections", F.lit("")).alias("sections"), F.col("sources").isNull().alias("has_gap"))
