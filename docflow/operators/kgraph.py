"""Knowledge graphs of documents: extraction tables, grounding, building, upserts, seeds of a query.

Tables: nodes (doc_id, node_id, type, name, aliases, chunk_ids), relations (doc_id, src, rel, dst,
confidence, chunk_ids), evidence (doc_id, item_id, chunk_id, quote).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import repair_json, strip, text_of

# Overlap that grounds a quote, seeds of a query, confidence an edge needs, shortest name matched.
OVERLAP, SEEDS, MIN_CONFIDENCE, SHORTEST = 0.55, 8, 0.4, 3
EVIDENCE = "evidence: array<struct<chunk_id: string, quote: string>>"
KNOWLEDGE = (
    f"struct<entities: array<struct<id: string, type: string, name: string, aliases: array<string>, {EVIDENCE}>>, "
    f"concepts: array<struct<id: string, label: string, {EVIDENCE}>>, "
    f"relations: array<struct<src: string, rel: string, dst: string, confidence: double, {EVIDENCE}>>>"
)


def knowledge_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KG1: (doc_id, batch, raw) model answers -> item and relation rows, evidence as arrays; junk gives none."""
    k = raw.select("doc_id", "batch", F.from_json(repair_json("raw"), KNOWLEDGE).alias("k"))
    none = F.array().cast("array<string>")
    item = lambda id_, type_, name, aliases, evidence: F.struct(id_.alias("node_id"), type_.alias("type"), name.alias("name"), aliases.alias("aliases"), evidence.alias("evidence"))
    ent = F.transform("k.entities", lambda e: item(e["id"], F.coalesce(e["type"], F.lit("Entity")), e["name"], F.coalesce(e["aliases"], none), e["evidence"]))
    con = F.transform("k.concepts", lambda e: item(e["id"], F.lit("Concept"), e["label"], none, e["evidence"]))
    # Outer, and filtered after: what an inner explode infers about its array would parse the answer again for each condition.
    each = lambda c, name: k.select("doc_id", "batch", F.posexplode_outer(c).alias("nth", name)).filter("nth is not null").drop("nth")
    items = each(F.flatten(F.filter(F.array(ent, con), lambda x: x.isNotNull())), "e").select("doc_id", "batch", "e.*")
    rel = each("k.relations", "e").select("doc_id", "batch", "e.src", "e.rel", "e.dst", "e.confidence", "e.evidence")
    return items, rel


def merge_knowledge(items: DataFrame, key: str = "node_id") -> DataFrame:
    """KG2: one item an id: the most evidence, then the earliest batch."""
    n = F.coalesce(F.size("evidence"), F.lit(0))
    rest = ["batch", *[c for c in items.columns if c not in ("doc_id", key, "batch")]]
    best = items.groupBy("doc_id", key).agg(F.min(F.struct((-n).alias("n"), F.struct(*rest).alias("x")))["x"].alias("x"))
    return best.select("doc_id", key, "x.*")


def grounded(quote: Column, text: Column, at: float = OVERLAP) -> Column:
    """A quote that its chunk contains, or shares `at` of its tokens with."""
    norm = lambda c: F.regexp_replace(strip(F.lower(text_of(c))), r"\s+", " ")
    q, c = norm(quote), norm(text)
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("[a-z0-9_]{3,}"), F.lit(0)))
    share = F.size(F.array_intersect(words(q), words(c))) / F.greatest(F.size(words(q)), F.lit(1))
    return (q != "") & (c != "") & (F.contains(c, q) | ((F.size(words(q)) > 0) & (share >= at)))


def ground_knowledge(nodes: DataFrame, relations: DataFrame, evidence: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """KG3: nodes with a grounded span, relations between two such nodes, and how many were kept and dropped."""
    e = evidence.join(chunks.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"])
    ok = e.filter(grounded(F.col("quote"), F.col("text"))).select("doc_id", F.col("item_id").alias("node_id")).distinct()
    kept = nodes.join(ok, ["doc_id", "node_id"], "left_semi")
    ids = kept.select("doc_id", "node_id")
    rel = relations.join(ids.withColumnRenamed("node_id", "src"), ["doc_id", "src"], "left_semi").join(ids.withColumnRenamed("node_id", "dst"), ["doc_id", "dst"], "left_semi")
    per = lambda a, b, what: a.groupBy("doc_id").count().join(b.groupBy("doc_id").agg(F.count("*").alias("kept")), "doc_id", "left").select("doc_id", F.lit(what).alias("kind"), F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("count") - F.coalesce("kept", F.lit(0))).alias("dropped"))
    return kept, rel, per(nodes, kept, "node").union(per(relations, rel, "relation"))


def _union_sets(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def graph_from_knowledge(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KG4: nodes by id (longest name, aliases and chunks together), edges by (src, rel, dst), the first one's confidence."""
    n = nodes.filter("coalesce(node_id, '') <> ''").groupBy("doc_id", "node_id").agg(F.min_by("type", "seq").alias("type"), F.max(F.struct(F.length(F.coalesce("name", "node_id")).alias("n"), (-F.col("seq")).alias("s"), F.coalesce("name", "node_id").alias("name")))["name"].alias("name"), _union_sets("aliases").alias("aliases"), _union_sets("chunk_ids").alias("chunk_ids"))
    e = relations.filter("coalesce(src, '') <> '' and coalesce(dst, '') <> ''").groupBy("doc_id", "src", F.coalesce("rel", F.lit("RELATES_TO")).alias("rel"), "dst")
    return n, e.agg(F.min_by(F.coalesce("confidence", F.lit(0.5)), "seq").alias("confidence"), F.min_by("chunk_ids", "seq").alias("chunk_ids"))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """KG5: the largest confidence and all evidence of every (doc_id, src, rel, dst)."""
    cols = ["doc_id", "src", "rel", "dst", "confidence", "chunk_ids"]
    return edges.select(cols).union(new.select(cols)).groupBy("doc_id", "src", "rel", "dst").agg(F.max("confidence").alias("confidence"), _union_sets("chunk_ids").alias("chunk_ids"))


def match_entities(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """KG6: nodes of a query's document whose name or alias, three characters or more, is in the query."""
    q = F.lower("query")
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    hit = F.exists(names, lambda x: (F.length(F.trim(x)) >= SHORTEST) & F.contains(q, F.lower(F.trim(x))))
    return queries.join(nodes, "doc_id").filter(hit).select("query_id", "doc_id", "node_id")


def neighbor_chunks(queries: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """KG7: a query's seed chunks: of matched nodes, of their neighbours over sure edges, then of the edges.

    Within each kind chunks come in order of their ids, so that the result does not depend on chance.
    """
    m = match_entities(queries, nodes)
    e = edges.filter(F.col("confidence") >= min_confidence)
    both = e.select("doc_id", F.col("src").alias("node_id"), F.col("dst").alias("other"), "chunk_ids").union(e.select("doc_id", F.col("dst").alias("node_id"), F.col("src").alias("other"), "chunk_ids"))
    hop = m.join(both, ["doc_id", "node_id"]).select("query_id", "doc_id", F.col("other").alias("node_id"))
    seeds = m.withColumn("hop", F.lit(0)).unionByName(hop.withColumn("hop", F.lit(1))).groupBy("query_id", "doc_id", "node_id").agg(F.min("hop").alias("hop"))
    of_nodes = seeds.join(nodes.select("doc_id", "node_id", "chunk_ids"), ["doc_id", "node_id"]).select("query_id", "hop", F.explode("chunk_ids").alias("chunk_id"))
    of_edges = seeds.select("query_id", "doc_id", "node_id").join(both, ["doc_id", "node_id"]).select("query_id", F.lit(2).alias("hop"), F.explode("chunk_ids").alias("chunk_id"))
    c = of_nodes.union(of_edges).groupBy("query_id", "chunk_id").agg(F.min("hop").alias("hop"))
    w = Window.partitionBy("query_id").orderBy("hop", "chunk_id")
    return c.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query_id", "chunk_id", "hop", "place")


def replace_graph(graph: DataFrame, new: DataFrame) -> DataFrame:
    """KG8: rows of the documents in `new` replaced by its rows."""
    return graph.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def export_graph(docs: DataFrame, graph: DataFrame, knowledge: DataFrame) -> DataFrame:
    """KG9: graph rows of the documents, from knowledge where the graph has none of a document."""
    have = graph.join(docs.select("doc_id"), "doc_id", "left_semi")
    lacking = docs.select("doc_id").join(graph.select("doc_id").distinct(), "doc_id", "left_anti")
    built = knowledge.join(lacking, "doc_id", "left_semi")
    return have.withColumn("built", F.lit(False)).unionByName(built.withColumn("built", F.lit(True)))
