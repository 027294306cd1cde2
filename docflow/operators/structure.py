"""Document structure: line blocks, sections, outline, and statistics of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import est_tokens, strip, text_of

# Patterns of captions and equations in a block, terms that make a section complex, lines of a page.
CAPTION = r"\b(figure|fig\.|table|caption)\b"
EQUATION = r"(\$[^$]+\$|∑|∫|=)"
TERMS = r"(?i)\b(algorithm|model|latency|carbon|embedding|protocol|theorem)\b"
PAGE_LINES = 8
# Histogram buckets of chunk tokens.
BUCKETS = (("0-99", 0, 99), ("100-249", 100, 249), ("250-399", 250, 399), ("400-499", 400, 499), ("500-900", 500, 900), ("901-1200", 901, 1200), ("1201+", 1201, 10**9))


def layout_blocks(elements: DataFrame) -> DataFrame:
    """STR1: (doc_id, pos, type, content) -> line blocks with page; tables stay whole; eight lines or more turn a page."""
    e = elements.filter(strip(text_of("content")) != "")
    table = (F.col("type") == "Table") | F.col("content").startswith("--- TABLE")
    lines = F.filter(F.transform(F.split("content", "\n"), strip), lambda x: x != "")
    whole = table | (F.size(lines) <= 1)
    e = e.withColumns({"table": table, "lines": F.when(whole, F.array("content")).otherwise(lines), "turn": F.when(~table & (F.size(lines) >= PAGE_LINES), 1).otherwise(0), "whole": whole})
    w = Window.partitionBy("doc_id").orderBy("pos")
    e = e.withColumn("page", F.sum("turn").over(w))
    b = e.select("doc_id", "pos", "type", "table", "whole", "page", F.posexplode("lines").alias("line", "text"))
    kind = F.when(F.col("table"), "Table").when(F.col("whole"), F.col("type")).when(F.col("type") == "Title", "Title").otherwise("Text")
    page = F.when(F.col("whole"), F.col("page")).otherwise(F.greatest(F.col("page"), F.lit(1)))
    order = Window.partitionBy("doc_id").orderBy("pos", "line")
    return b.select("doc_id", (F.row_number().over(order) - 1).alias("index"), "text", kind.alias("block_type"), page.alias("page"))


def build_sections(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """STR3: blocks and accepted headings (doc_id, index, level) -> one row a section; what precedes is the preamble, section 0."""
    h = headings.select("doc_id", "index", "level", F.lit(1).alias("opens"))
    b = blocks.join(h, ["doc_id", "index"], "left").withColumn("section", F.sum(F.coalesce("opens", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("index")))
    low = F.lower("text")
    part = (
        F.when(F.col("opens") == 1, "heading").when((F.lower("block_type") == "table") | F.col("text").startswith("--- TABLE"), "table").when(F.lower("block_type") == "list", "list")
        .when(F.substring(low, 1, 80).rlike(CAPTION) & (F.size(F.split("text", r"\s+")) <= 30), "caption").when(F.col("text").rlike(EQUATION) & (F.length("text") < 400), "equation").otherwise("paragraph")
    )
    b = b.withColumn("part", part)
    g = b.groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("part") == "heading", F.col("text"))).alias("heading"), F.coalesce(F.max("level"), F.lit(1)).alias("level"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        *[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("paragraph", "table", "list", "caption", "equation")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") != "heading", F.struct("index", "text")))), lambda x: x["text"]), "\n").alias("body"),
    )
    return g.filter("body <> ''").withColumn("heading", F.coalesce("heading", F.lit("Preamble"))).withColumn("tokens", est_tokens("body"))


def section_scores(sections: DataFrame) -> DataFrame:
    """STR4: importance by level, tokens and equations; complexity by equations, terms and tokens."""
    eq, terms = F.regexp_count("body", F.lit(EQUATION)), F.regexp_count("body", F.lit(TERMS))
    imp = F.least(F.lit(1.0), 0.35 + 0.15 * F.greatest(F.lit(0), 3 - F.col("level")) + 0.0004 * F.col("tokens") + 0.05 * F.least(eq, F.lit(4)))
    com = F.least(F.lit(1.0), 0.25 + 0.08 * F.least(eq, F.lit(5)) + 0.03 * F.least(terms, F.lit(8)) + 0.0003 * F.col("tokens"))
    return sections.withColumn("importance", imp).withColumn("complexity", com)


def section_tree(sections: DataFrame, levels: int = 6) -> DataFrame:
    """STR5: each section's parent: the nearest earlier section of a smaller level, by one running value a level."""
    w = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") < k, F.col("section")), ignorenulls=True).over(w) for k in range(1, levels + 1)]
    parent = F.coalesce(*[F.when(F.least(F.col("level"), F.lit(levels)) == k, c) for k, c in enumerate(last, 1)])
    return sections.select("doc_id", "section", "level", parent.alias("parent"))


def structure_diagnostics(chunks: DataFrame) -> DataFrame:
    """STR9: chunks of a document with mean, median, least and most tokens."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.avg("tokens").alias("mean_tokens"), F.percentile("tokens", F.lit(0.5)).alias("median_tokens"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"))


def compare_blocks(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """STR10: blocks by kind in both parses with their difference; titles only in a; titles in both."""
    side = lambda df, n: df.groupBy("block_type").agg(F.count("*").alias(n))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = side(a, "a_count").join(side(b, "b_count"), "block_type", "full").select("block_type", z("a_count"), z("b_count")).withColumn("delta", F.col("b_count") - F.col("a_count"))
    titles = lambda df: df.filter("block_type = 'Title'").select("doc_id", "text")
    return counts, titles(a).subtract(titles(b)), titles(a).intersect(titles(b))


def force_cap(chunks: DataFrame, cap: int) -> DataFrame:
    """CHK3: a document's chunks merged into `cap` even groups where it has more."""
    doc = Window.partitionBy("doc_id")
    c = chunks.withColumn("i", F.row_number().over(doc.orderBy("chunk_index")) - 1).withColumn("n", F.count("*").over(doc))
    # The group whose floor bounds hold i: the largest g with floor(g * n / cap) <= i.
    g = F.when(F.col("n") <= cap, F.col("i")).otherwise(F.floor(((F.col("i") + 1) * cap - 1) / F.col("n")))
    c = c.withColumn("g", g.cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(strip(text_of("content")) != "", F.struct("i", "content")))), lambda x: x["content"]), "\n\n")
    return c.groupBy("doc_id", F.col("g").alias("chunk_index")).agg(text.alias("content"), F.count("*").alias("merged"))


def reindex(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CHK4: chunks renumbered from 0, and each parent's children in order."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    c = chunks.withColumn("chunk_index", F.row_number().over(w) - 1)
    return c, c.groupBy("doc_id", "parent_id").agg(F.array_sort(F.collect_list("chunk_index")).alias("children"))


def pack_by_budget(blocks: DataFrame, most: int) -> DataFrame:
    """CHK5: blocks packed by running tokens: a block's chunk is the budget its first token falls in."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = blocks.withColumn("pack", F.floor(before / most))
    return b.groupBy("doc_id", "pack").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"), F.min("chunk_index").alias("first_block"))


def chunk_token_stats(chunks: DataFrame) -> DataFrame:
    """CHK6: a document's chunk tokens: mean, median, spread, shares under and over, and a histogram."""
    t = F.col("tokens")
    pct = lambda cond: 100.0 * F.count_if(cond) / F.count("*")
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("count"), F.avg(t).alias("average"), F.percentile(t, F.lit(0.5)).alias("median"), F.min(t).alias("min"), F.max(t).alias("max"), F.stddev_pop(t).alias("stdev"),
        *[pct(t < k).alias(f"pct_under_{k}") for k in (100, 250, 400)], pct(t.between(500, 900)).alias("pct_500_900"), pct(t > 1200).alias("pct_above_1200"),
        *[F.count_if(t.between(lo, hi)).alias(f"bucket_{lo}") for _, lo, hi in BUCKETS],
    )


def chunk_examples(chunks: DataFrame, k: int = 5) -> DataFrame:
    """CHK7: the k smallest and k largest chunks of each document."""
    w = Window.partitionBy("doc_id")
    small = chunks.withColumn("place", F.row_number().over(w.orderBy("tokens", "chunk_index"))).withColumn("side", F.lit("smallest"))
    large = chunks.withColumn("place", F.row_number().over(w.orderBy(F.desc("tokens"), "chunk_index"))).withColumn("side", F.lit("largest"))
    return small.filter(F.col("place") <= k).unionByName(large.filter(F.col("place") <= k))


def split_reason_hist(chunks: DataFrame) -> DataFrame:
    """CHK8: chunks by why they were split off."""
    return chunks.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("chunks"))
