"""Queries of retrieval and context packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docflow.operators import context as X
from docflow.operators import retrieval as R
from docflow.operators.cgraph import written
from docflow.operators.evaluation import freeze_retrieval

from .bindings import CHUNKS, QUERY_ROWS, chunks, queries, table
from .registry import register


def corpus(spark, d):
    return table(spark, d, "documents").select(F.lit("all").alias("scope"), F.col("doc_id").alias("chunk_id"), "text")


def asked(spark, d):
    return queries(spark, d).withColumn("scope", F.lit("all"))


_TERMS = "regexp_extract_all(lower({}), '[a-zA-Z0-9_]{{2,}}')"
BM25 = f"""{QUERY_ROWS}, tok AS (SELECT doc_id, {_TERMS.format('text')} AS ts FROM documents), dl AS (SELECT doc_id, len(ts) AS dl FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TERMS.format('query')}) AS term FROM queries) GROUP BY 1, 2),
bm AS (SELECT query_id, tf.doc_id AS chunk_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(dl, 1) / greatest(avgdl, 1e-9)))) AS score
  FROM q JOIN tf USING (term) JOIN dfs USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY 1, 2),
bm25 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM bm WHERE score > 0)"""


@register(f"WITH tok AS (SELECT doc_id, {_TERMS.format('text')} AS ts FROM documents) SELECT doc_id AS chunk_id, term, tf, dl FROM (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY 1, 2)")
def ret1_bm25_index(spark, d):
    return R.bm25_index(corpus(spark, d))[0].select("chunk_id", "term", "tf", "dl")


@register(f"WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM bm25 WHERE place <= 5")
def ret2_bm25_search(spark, d):
    return R.bm25_search(corpus(spark, d), asked(spark, d), 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place")


def dense(spark, d, k=10):
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("scope"), F.col("embedding").alias("v"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("q"))
    return R.dense_search(v, q, k)


DENSE = """de AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM de)"""


@register(f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM dense WHERE place <= 10")
def ret3_dense_search(spark, d):
    return dense(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place")


_FUSED = """l AS (SELECT query_id, chunk_id, place FROM bm25 WHERE place <= 20 UNION ALL SELECT query_id, chunk_id, place FROM dense WHERE place <= 10),
fu AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + place)) AS score FROM l GROUP BY 1, 2), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM fu)"""


@register(f"WITH {BM25}, {DENSE}, {_FUSED} SELECT query_id, chunk_id, round(score, 9) AS score, CAST(place AS INTEGER) AS place FROM fused WHERE place <= 10")
def ret4_rrf(spark, d):
    lists = R.bm25_search(corpus(spark, d), asked(spark, d), 20).select("query_id", "chunk_id", "place").union(dense(spark, d).select("query_id", "chunk_id", "place"))
    return R.rrf(lists, top_n=10).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "place")


@register(f"""WITH {BM25}, {DENSE}, l AS (SELECT query_id, chunk_id, place FROM bm25 WHERE place <= 20 UNION ALL SELECT query_id, chunk_id, place FROM dense WHERE place <= 10),
  a AS (SELECT * FROM l UNION ALL SELECT item_id AS query_id, item_id + 1 AS chunk_id, 1 AS place FROM benchmark),
  fu AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + place)) AS score FROM a GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM fu)
  SELECT query_id, chunk_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.query_id = f.query_id AND l.chunk_id = f.chunk_id) THEN 'rrf' ELSE 'graph_seed' END AS source FROM f WHERE place <= 8""")
def ret6_hybrid_search(spark, d):
    seeds = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") + 1).alias("chunk_id"), F.lit(1).alias("place"))
    lex = R.bm25_search(corpus(spark, d), asked(spark, d), 20)
    return R.hybrid_search(lex, dense(spark, d), seeds, 8).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place", "source")


@register(f"WITH {BM25}, s AS (SELECT query_id, chunk_id, place, CASE WHEN chunk_id % 3 <> 0 THEN chunk_id % 7 END AS ns FROM bm25 WHERE place <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ns DESC NULLS LAST, place, chunk_id) AS new_place FROM s) SELECT query_id, chunk_id, CAST(new_place AS INTEGER) AS new_place FROM r WHERE new_place <= 4")
def ret7_rerank(spark, d):
    hits = R.bm25_search(corpus(spark, d), asked(spark, d), 10)
    return R.rerank(hits, 4, F.when(F.col("chunk_id") % 3 != 0, F.col("chunk_id") % 7)).select("query_id", "chunk_id", "new_place")


def line_chunks(spark, d):
    c = chunks(spark, d)
    return c.select(F.lit("all").alias("scope"), F.concat_ws("_", "doc_id", "chunk_index").alias("chunk_id"), F.col("content").alias("text"), "parent_id", F.col("chunk_index").alias("position"))


_CHUNK_BM25 = BM25.replace("FROM documents)", "FROM cdocs)", 1).replace("tok AS (", CHUNKS + ", cdocs AS (SELECT doc_id || '_' || chunk_index AS doc_id, content AS text FROM chunks), tok AS (", 1)


@register(f"""WITH {_CHUNK_BM25}, hits AS (SELECT query_id, chunk_id, score, place, parent_id FROM (SELECT * FROM bm25 WHERE place <= 6) JOIN (SELECT doc_id || '_' || chunk_index AS chunk_id, parent_id FROM chunks) USING (chunk_id)),
  p AS (SELECT query_id, parent_id, min(place) AS first, max(score) AS best FROM hits GROUP BY 1, 2),
  f AS (SELECT query_id, p.parent_id, first, best, doc_id || '_' || chunk_index AS sibling, chunk_index FROM p JOIN chunks ON chunks.parent_id = p.parent_id),
  g AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.query_id = f.query_id AND hits.chunk_id = f.sibling)),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY chunk_index) AS r FROM g), e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, parent_id) AS n FROM o WHERE r = 1)
  SELECT query_id, sibling AS chunk_id, parent_id, round(best * 0.85, 6) AS score FROM e WHERE n <= 3""")
def ret8_parent_expand(spark, d):
    c = line_chunks(spark, d)
    hits = written(R.bm25_search(c, asked(spark, d), 6)).join(c.select("chunk_id", "parent_id"), "chunk_id")
    return R.parent_expand(hits, c).select("query_id", "chunk_id", "parent_id", F.round("score", 6).alias("score"))


@register(f"WITH {BM25} SELECT query_id, chunk_id, CAST(place AS INTEGER) AS place, source, lang FROM bm25 LEFT JOIN documents ON doc_id = chunk_id WHERE place <= 5")
def ret9_attach_meta(spark, d):
    hits = R.bm25_search(corpus(spark, d), asked(spark, d), 5)
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "lang")
    return R.attach_meta(hits, meta).select("query_id", "chunk_id", "place", "source", "lang")


def _letters(batches):
    """A stand-in for a model: shares of five vowels."""
    for b in batches:
        yield pd.DataFrame({"key": b["key"], "vector": [[t.count(c) / max(1, len(t)) for c in "aeiou"] for t in b["text"]]})


@register("""WITH v AS (SELECT doc_id, text, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: (length(text) - length(replace(text, c, ''))) / greatest(1, length(text))) AS w FROM documents)
  SELECT doc_id AS text_id, round(list_sum(w), 6) AS vowels, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) AS hit FROM v""")
def ret10_embed_with_cache(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    old = t.filter("text_id % 3 = 0").withColumn("key", R.embed_key(F.lit("m"), F.lit("passage"), "text"))
    vowel = lambda c: F.length(F.regexp_replace("text", f"[^{c}]", "")) / F.greatest(F.lit(1), F.length("text"))
    cache = old.dropDuplicates(["key"]).select("key", F.array(*[vowel(c) for c in "aeiou"]).alias("vector"))
    out, _ = R.embed_with_cache(t, cache, _letters, "m")
    return out.select("text_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("vowels"), "hit")


@register("""WITH s AS (SELECT user_id, event_id, ts AS b, ts + INTERVAL 6 HOUR AS e FROM events WHERE event_type = 'view')
  SELECT s.user_id AS session_id, s.event_id AS query_id, o.event_type AS op, o.event_id AS op_id FROM s JOIN events o ON o.user_id = s.user_id AND o.ts BETWEEN b AND e WHERE o.event_type IN ('signup', 'error')""")
def ret11_query_path_violations(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    spans = e.filter("event_type = 'view'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("query_id"), F.col("at").alias("begin_at"), (F.col("at") + F.expr("interval 6 hours")).alias("end_at"))
    ops = e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("op"), F.col("event_id").alias("op_id"), "at")
    return R.query_path_violations(spans, ops, ("signup", "error"))


def passages(spark, d):
    c = table(spark, d, "conversations")
    t = F.col("turn")
    df = c.select(F.col("conv_id").alias("query_id"), t.alias("chunk_id"), F.col("text").alias("content"), ((t * 37) % 10 / 10).alias("score"), t.alias("rank"), F.when(t % 3 != 0, F.floor(t / 3)).alias("parent_id"), F.when(t % 5 != 4, F.col("role")).alias("section_path"))
    return X.normalize_passages(df)


PASSAGES = """passages AS (SELECT conv_id AS query_id, CAST(turn AS VARCHAR) AS chunk_id, text AS content, ((turn * 37) % 10) / 10.0::DOUBLE AS score, CAST(turn AS INTEGER) AS rank, CAST(CASE WHEN turn % 3 <> 0 THEN turn // 3 END AS VARCHAR) AS parent_id, CASE WHEN turn % 5 <> 4 THEN role END AS section_path FROM conversations WHERE coalesce(text, '') <> '')"""
MERGED = PASSAGES + """, merged AS (SELECT query_id, coalesce('parent ' || parent_id, 'solo ' || chunk_id) AS block, string_agg(content, chr(10) || chr(10) ORDER BY coalesce(section_path, ''), rank, chunk_id) AS content, list(chunk_id ORDER BY coalesce(section_path, ''), rank, chunk_id) AS chunk_ids,
  max(score) AS score, min(rank) AS rank, first(section_path ORDER BY coalesce(section_path, ''), rank, chunk_id) AS section_path FROM passages GROUP BY 1, 2),
cited AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section_path IS NULL, coalesce(section_path, ''), rank) AS citation FROM merged)"""


@register(f"WITH {PASSAGES} SELECT query_id, chunk_id, round(score, 6) AS score, rank, parent_id, section_path, length(content) AS n FROM passages")
def ctx1_normalize_passages(spark, d):
    return passages(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "parent_id", "section_path", F.length("content").cast("long").alias("n"))


@register()
def ctx2_dedupe_passages(spark, d):
    return X.dedupe_passages(passages(spark, d)).select("query_id", "chunk_id", "score", "rank")


@register(f"WITH {MERGED} SELECT query_id, content, array_to_string(chunk_ids, ',') AS chunk_ids, round(score, 6) AS score, rank, section_path FROM merged")
def ctx3_merge_siblings(spark, d):
    return X.merge_siblings(passages(spark, d)).select("query_id", "content", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.round("score", 6).alias("score"), "rank", "section_path")


@register()
def ctx4_select_under_budget(spark, d):
    out = X.select_under_budget(X.merge_siblings(passages(spark, d)), 200)
    return out.select("query_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.length("content").alias("n_chars"), "score", "rank")


@register(f"WITH {MERGED} SELECT query_id, string_agg('[' || citation || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY citation) AS context_text FROM cited GROUP BY 1")
def ctx5_assemble_context(spark, d):
    return X.assemble_context(X.merge_siblings(passages(spark, d)))[0].select("query_id", "context_text")


@register(f"""WITH {MERGED}, p AS (SELECT query_id, unnest(chunk_ids) AS chunk_id, citation, score, section_path FROM cited),
  g AS (SELECT query_id, count(DISTINCT citation) AS citations, count(*) AS sources, round(avg(least(1, greatest(0, score))), 6) AS confidence, string_agg(DISTINCT coalesce(section_path, '(no section)'), ', ' ORDER BY coalesce(section_path, '(no section)')) AS sections FROM p GROUP BY 1)
  SELECT DISTINCT c.conv_id AS query_id, coalesce(citations, 0) AS citations, coalesce(sources, 0) AS sources, coalesce(confidence, 0.0) AS confidence, coalesce(sections, '') AS sections, sources IS NULL AS has_gap FROM conversations c LEFT JOIN g ON g.query_id = c.conv_id""")
def ctx6_answer_envelopes(spark, d):
    _, provenance = X.assemble_context(X.merge_siblings(passages(spark, d)))
    answers = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.lit("").alias("answer")).distinct()
    return X.answer_envelopes(provenance, answers).select("query_id", "citations", "sources", F.round("confidence", 6).alias("confidence"), "sections", "has_gap")


@register()
def evl11_freeze_retrieval(spark, d):
    c = line_chunks(spark, d)
    hits = R.bm25_search(c, asked(spark, d), 6)
    meta = c.select("chunk_id", F.col("text").alias("content"), "parent_id", F.col("parent_id").alias("section_path"))
    return freeze_retrieval(hits, meta, 300).select("query_id", "tokens_used", "chunk_ids", "context_hash")
