"""Queries of sources, structure and chunk statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docflow.operators import folds as L
from docflow.operators import headings as H
from docflow.operators import structure as S
from docflow.session import shared_folder
from docflow.sources import documents as D

from .bindings import CHUNKS, QUERY_ROWS, chunks, queries, table
from .registry import register


def r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


#: Documents with a blank line after every third line.
_SPACED = r"regexp_replace(text, '([^\n]*\n[^\n]*\n[^\n]*)\n', '\1' || chr(10) || chr(10), 'g')"


def spaced(spark, d):
    # Matches begin at the start of a line only, else a long line would be read again from each of its characters.
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(?md)^([^\n]*+\n[^\n]*+\n[^\n]*+)\n", "$1\n\n").alias("text"))


@register(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({_SPACED}, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS block, left(l[i], 20000) AS content FROM p, unnest(range(1, len(l) + 1)) t(i)""")
def src1_text_blocks(spark, d):
    return D.text_blocks(spaced(spark, d))


@register()
def src2_html_elements(spark, d):
    return D.html_elements(table(spark, d, "pages"))


_HEAD = [("# Results so far", True), ("1.2 Problem Statement", True), ("CARBON AWARE ROUTING", True), ("Retrieval Techniques", True), ("this is plain text that runs on", False), ("Ends with a stop.", False), ("abc", False)]


@register(f"SELECT event_id, list_extract({[b for _, b in _HEAD]}, CAST(event_id % {len(_HEAD)} + 1 AS INTEGER)) AS heading FROM events")
def src3_looks_like_heading(spark, d):
    line = F.element_at(F.array(*[F.lit(t) for t, _ in _HEAD]), (F.col("event_id") % len(_HEAD) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", D.looks_like_heading(line).alias("heading"))


_FILES = [("a/report.PDF", "%PDF-1.7", ".pdf", None), ("x.docx", "no zip", ".docx", "not_a_docx"), ("n.txt", "fine text", ".txt", None), ("s.csv", "a,<script>x", ".csv", "markup_in_text"), ("y.exe", "MZ", ".exe", "unsupported_type"), ("e.txt", "", ".txt", "empty")]


@register("SELECT event_id AS file_id, x.e AS extension, x.r IS NULL AS accepted, x.r AS reason FROM (SELECT event_id, list_extract([" + ", ".join(f"{{'e': '{e}', 'r': {'NULL' if r is None else repr(r)}}}" for _, _, e, r in _FILES) + f"], CAST(event_id % {len(_FILES)} + 1 AS INTEGER)) AS x FROM events)")
def src4_validate_uploads(spark, d):
    pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in _FILES]), (F.col("event_id") % len(_FILES) + 1).cast("int"))
    return D.validate_uploads(table(spark, d, "events").select(F.col("event_id").alias("file_id"), pick(0).alias("name"), pick(1).alias("content")))


_BYTES = [(".PDF", "%PDF-1.7 ", "application/pdf", None), (".docx", "PK", "", "not_a_docx"), (".txt", "", "text/plain; charset=utf-8", None), (".csv", "a,< script>", "", "markup_in_text"), (".txt", "a\0", "", "binary_text"), (".pdf", "", "", "not_a_pdf"), (".txt", "", "image/png", "unsupported_content_type")]


@register("SELECT doc_id, lower(x.n) AS extension, r IS NULL AS accepted, r AS reason FROM (SELECT *, CASE WHEN x.r <> '' THEN x.r WHEN x.n = '.txt' AND regexp_matches(left(text, 200), '(?i)<\\s*script\\b|javascript\\s*:|on[a-zA-Z0-9_]+\\s*=|<\\s*iframe\\b|<\\s*object\\b|<\\s*embed\\b|<html') THEN 'markup_in_text' END AS r FROM (SELECT doc_id, text, list_extract([" + ", ".join(f"{{'n': '{n}', 'r': '{r or ''}'}}" for n, _, _, r in _BYTES) + f"], CAST(doc_id % {len(_BYTES)} + 1 AS INTEGER)) AS x FROM documents))")
def src4_upload_bytes(spark, d):
    """Documents as files of every kind, some damaged."""
    pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in _BYTES]), (F.col("doc_id") % len(_BYTES) + 1).cast("int"))
    f = table(spark, d, "documents").select("doc_id", F.concat(F.lit("up/f"), "doc_id", pick(0)).alias("name"), pick(2).alias("content_type"), F.concat(pick(1), F.substring("text", 1, 200)).cast("binary").alias("content"))
    return D.validate_upload_bytes(f).select("doc_id", "extension", "accepted", "reason")


@register("SELECT conv_id, turn, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n, CASE WHEN length(text) > 300 THEN 'too_long' WHEN turn % 4 = 3 THEN 'script' END AS rejected FROM conversations WHERE length(text) = length(trim(text)) OR turn >= 0".replace("length(text) > 300", "length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) + CASE WHEN turn % 4 = 3 THEN 20 ELSE 0 END > 300").replace("AS n, CASE", "+ CASE WHEN turn % 4 = 3 THEN 20 ELSE 0 END AS n, CASE"))
def src5_sanitize_text(spark, d):
    t = F.concat(F.lit("\x01"), D.strip("text"), F.when(F.col("turn") % 4 == 3, F.lit(" javascript: alert(1)"[:20])).otherwise(F.lit("")))
    s, why = D.sanitize_text(t, 300)
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(s).cast("long").alias("n"), why.alias("rejected"))


def versions(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % 97).alias("chunk_id"), F.col("event_id").alias("version"), F.repeat(F.lit("s/"), (F.col("event_id") % 300).cast("int")).alias("section_path"), "value")


@register("SELECT chunk_id, version, left(repeat('s/', CAST(version % 300 AS INTEGER)), 500) AS section_path, value FROM (SELECT event_id % 97 AS chunk_id, event_id AS version, value, row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def src6_upsert_chunks(spark, d):
    v = versions(spark, d)
    return D.upsert_chunks(v.filter("version % 2 = 0"), v.filter("version % 2 = 1"))


@register(f"WITH {CHUNKS} SELECT doc_id, chunk_index FROM chunks WHERE doc_id % 5 <> 0")
def src7_delete_documents(spark, d):
    gone = table(spark, d, "documents").filter("doc_id % 5 = 0").select("doc_id")
    return D.delete_documents(chunks(spark, d), gone).select("doc_id", "chunk_index")


@register("SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, event_type, 'm' || (event_id % 3) AS selected_model, CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS confidence, value AS latency_ms, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1.5::DOUBLE END AS carbon FROM events")
def src9_flatten_routing_events(spark, d):
    i = F.col("event_id")
    ev = F.to_json(F.struct(F.col("user_id").alias("job_id"), F.when(i % 2 == 0, F.col("event_type")).alias("event"), F.col("event_type").alias("event_type"), F.concat(F.lit("m"), i % 3).alias("selected_model"), F.when(i % 2 == 0, 0.5).alias("confidence"), F.lit(0.25).alias("validation_confidence"), F.col("value").alias("latency_ms"), F.when(i % 3 == 0, "n/a").otherwise("1.5").alias("carbon_estimate")))
    out = D.flatten_routing_events(table(spark, d, "events").select("event_id", ev.alias("event")))
    return out.select("event_id", "job_id", "event_type", "selected_model", "confidence", "latency_ms", "carbon")


@register("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def src10_recent_events(spark, d):
    return D.recent_events(table(spark, d, "events")).select("event_id", "event_type")


@register("SELECT user_id AS campaign_id, event_type AS question, event_id AS run_id, value AS latency_ms FROM events")
def src11_campaign_runs(spark, d):
    e = table(spark, d, "events")
    q = e.groupBy("user_id", "event_type").agg(F.collect_list(F.struct(F.col("event_id").alias("run_id"), F.col("value").alias("latency_ms"))).alias("model_runs"))
    c = q.groupBy(F.col("user_id").alias("campaign_id")).agg(F.collect_list(F.struct(F.col("event_type").alias("question"), "model_runs")).alias("questions"))
    return D.campaign_runs(c).select("campaign_id", "question", "run_id", "latency_ms")


@register("SELECT o_orderkey AS campaign_id, CASE WHEN o_orderkey % 2 = 0 THEN 'rag-' || (o_orderkey % 5) ELSE 'plain summarization' END AS label, CASE WHEN o_orderkey % 2 = 1 THEN 'document_summarization' ELSE 'interactive_rag' END AS workload, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'failed' ELSE 'complete' END AS status FROM orders")
def src12_campaign_index(spark, d):
    k = F.col("o_orderkey")
    df = table(spark, d, "orders").select(k.alias("campaign_id"), F.when(k % 2 == 0, F.concat(F.lit("campaign_20260101_v1.4.0_rag-"), k % 5)).otherwise("plain summarization").alias("name"), F.when(k % 3 == 0, 0.0).otherwise(1.0).alias("cost_usd"), (k % 4 == 0).alias("dry_run"), F.col("o_orderdate").alias("at"))
    return D.campaign_index(df).select("campaign_id", "label", "workload", "status")


@register(f"WITH {QUERY_ROWS} SELECT query_id, CASE WHEN query_id % 2 = 0 THEN text END AS reference FROM queries JOIN benchmark ON item_id = query_id")
def src13_join_references(spark, d):
    q = queries(spark, d).select("query_id", F.concat(F.lit(" "), "query").alias("question"))
    refs = queries(spark, d).join(table(spark, d, "benchmark"), F.col("item_id") == F.col("query_id")).filter("query_id % 2 = 0").select(F.col("query").alias("question"), F.col("text").alias("reference"))
    return D.join_references(q, refs).select("query_id", "reference")


@register("SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 0 THEN 'id' || page_id WHEN page_id % 3 = 0 THEN 'name' || page_id END AS reference FROM pages")
def src14_join_summary_refs(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").select(k.alias("doc_id"), F.concat(F.lit("in/Doc"), k, F.lit(".pdf")).alias("name"))
    refs = p.filter("doc_id % 2 = 0 or doc_id % 3 = 0").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("ref_id"), F.when(F.col("doc_id") % 2 != 0, F.concat(F.lit("doc"), "doc_id", F.lit(".PDF"))).alias("ref_name"), F.concat(F.when(F.col("doc_id") % 2 == 0, "id").otherwise("name"), "doc_id").alias("reference"))
    return D.join_summary_refs(p, refs).select("doc_id", "reference")


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 1.0 END AS weight FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part)")
def src15_load_graph(spark, d):
    n = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey")))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("weight"))
    return D.load_graph(n, l).select("l_orderkey", "l_linenumber", "weight")


@register(f"WITH {CHUNKS} SELECT CASE WHEN doc_id % 4 = 0 THEN doc_id + 100000 ELSE doc_id END AS doc_id, chunk_index FROM chunks")
def src16_align_document_id(spark, d):
    c = table(spark, d, "documents").filter("doc_id % 4 = 0").select("doc_id", (F.col("doc_id") + 100000).alias("canonical_id"))
    return D.align_document_id(chunks(spark, d).select("doc_id", "chunk_index"), c)


@register("SELECT o_orderkey AS doc_id FROM orders WHERE o_custkey = 7")
def src17_list_documents(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("saved_at"))
    return D.list_documents(o, 7).select("doc_id")


# Elements: every third line of a document opens one; the first is a title, every seventh a table.


def elements(spark, d):
    c = chunks(spark, d)
    g = c.groupBy("doc_id", F.floor(F.col("chunk_index") / 3).alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n").alias("content"))
    return g.withColumn("type", F.when(F.col("pos") == 0, "Title").when(F.col("pos") % 7 == 3, "Table").otherwise("Text"))


BLOCKS = CHUNKS + """, el AS (SELECT doc_id, chunk_index // 3 AS pos, string_agg(content, chr(10) ORDER BY chunk_index) AS content, count(*) AS n FROM chunks GROUP BY 1, 2),
ek AS (SELECT *, CASE WHEN pos = 0 THEN 'Title' WHEN pos % 7 = 3 THEN 'Table' ELSE 'Text' END AS type FROM el),
bk0 AS (SELECT doc_id, pos, type, 0 AS line, content AS text, CASE WHEN type = 'Table' OR n <= 1 THEN 0 ELSE 1 END AS page, CASE WHEN type = 'Table' THEN 'Table' ELSE type END AS block_type FROM ek WHERE type = 'Table' OR n <= 1 UNION ALL
  SELECT k.doc_id, pos, type, chunk_index, c.content, 1, CASE WHEN type = 'Title' THEN 'Title' ELSE 'Text' END FROM ek k JOIN chunks c ON c.doc_id = k.doc_id AND c.chunk_index // 3 = pos WHERE type <> 'Table' AND n > 1),
blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, line) - 1 AS INTEGER) AS index, text, block_type, page FROM bk0)"""


def blocks(spark, d):
    return S.layout_blocks(elements(spark, d))


@register(f'WITH {BLOCKS} SELECT doc_id, "index", text, block_type, CAST(page AS BIGINT) AS page FROM blocks')
def str1_layout_blocks(spark, d):
    return blocks(spark, d).select("doc_id", "index", "text", "block_type", F.col("page").cast("long").alias("page"))


def sections(spark, d):
    b = blocks(spark, d)
    return S.build_sections(b, b.filter("index % 5 = 2").select("doc_id", "index", (F.col("index") % 3 + 1).alias("level")))


SECTIONS = BLOCKS + rf""", s0 AS (SELECT *, "index" % 5 = 2 AS opens, sum(CASE WHEN "index" % 5 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "index") AS section FROM blocks),
s1 AS (SELECT *, CASE WHEN opens THEN 'heading' WHEN block_type = 'Table' THEN 'table' WHEN regexp_matches(left(lower(text), 80), '{S.CAPTION}') AND len(regexp_split_to_array(text, '\s+')) <= 30 THEN 'caption' WHEN regexp_matches(text, '{S.EQUATION}') AND length(text) < 400 THEN 'equation' ELSE 'paragraph' END AS part FROM s0),
sections AS (SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(max(CASE WHEN opens THEN text END), 'Preamble') AS heading, coalesce(max(CASE WHEN opens THEN "index" % 3 + 1 END), 1) AS level, count_if(part = 'paragraph') AS n_paragraph, count_if(part = 'table') AS n_table, string_agg(text, chr(10) ORDER BY "index") FILTER (NOT opens) AS body FROM s1 GROUP BY 1, 2 HAVING count_if(NOT opens) > 0)"""


@register(f"WITH {SECTIONS} SELECT doc_id, section, heading, CAST(level AS INTEGER) AS level, n_paragraph, n_table, CAST(greatest(1, length(body) // 4) AS INTEGER) AS tokens FROM sections")
def str3_build_sections(spark, d):
    return sections(spark, d).select("doc_id", "section", "heading", "level", "n_paragraph", "n_table", "tokens")


@register(rf"""WITH {SECTIONS}, x AS (SELECT *, greatest(1, length(body) // 4) AS t, len(regexp_extract_all(body, '{S.EQUATION}')) AS eq, len(regexp_extract_all(body, '{S.TERMS}')) AS te FROM sections)
  SELECT doc_id, section, round(least(1, 0.35::DOUBLE + 0.15::DOUBLE * greatest(0, 3 - level) + 0.0004::DOUBLE * t + 0.05::DOUBLE * least(eq, 4)), 8) AS importance, round(least(1, 0.25::DOUBLE + 0.08::DOUBLE * least(eq, 5) + 0.03::DOUBLE * least(te, 8) + 0.0003::DOUBLE * t), 8) AS complexity FROM x""")
def str4_section_scores(spark, d):
    return S.section_scores(sections(spark, d)).select("doc_id", "section", F.round("importance", 8).alias("importance"), F.round("complexity", 8).alias("complexity"))


@register(f"WITH {SECTIONS} SELECT doc_id, section, CAST(level AS INTEGER) AS level, (SELECT max(p.section) FROM sections p WHERE p.doc_id = s.doc_id AND p.section < s.section AND p.level < s.level) AS parent FROM sections s")
def str5_section_tree(spark, d):
    return S.section_tree(sections(spark, d))


def sized(spark, d):
    return chunks(spark, d).withColumn("tokens", F.greatest(F.lit(1), F.length("content")))


_SIZED = CHUNKS + ", sz AS (SELECT *, greatest(1, length(content)) AS tokens FROM chunks)"


@register(f"WITH {_SIZED} SELECT doc_id, count(*) AS chunks, round(avg(tokens), 6) AS mean_tokens, round(quantile_cont(tokens, 0.5), 6) AS median_tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens FROM sz GROUP BY 1")
def str9_structure_diagnostics(spark, d):
    out = S.structure_diagnostics(sized(spark, d))
    return out.select("doc_id", "chunks", *r6(["mean_tokens", "median_tokens"]), F.col("min_tokens").cast("long").alias("min_tokens"), F.col("max_tokens").cast("long").alias("max_tokens"))


@register(f"""WITH {BLOCKS}, b AS (SELECT CASE WHEN "index" % 4 = 1 AND block_type = 'Text' THEN 'Title' ELSE block_type END AS block_type FROM blocks WHERE "index" % 6 <> 0) SELECT block_type, (SELECT count(*) FROM blocks x WHERE x.block_type = t.block_type) AS a_count, (SELECT count(*) FROM b WHERE b.block_type = t.block_type) AS b_count,
  (SELECT count(*) FROM b WHERE b.block_type = t.block_type) - (SELECT count(*) FROM blocks x WHERE x.block_type = t.block_type) AS delta FROM (SELECT DISTINCT block_type FROM blocks UNION SELECT block_type FROM b) t""")
def str10_compare_blocks(spark, d):
    a = blocks(spark, d)
    b = a.filter("index % 6 <> 0").withColumn("block_type", F.when((F.col("index") % 4 == 1) & (F.col("block_type") == "Text"), "Title").otherwise(F.col("block_type")))
    return S.compare_blocks(a, b)[0]


@register(f"WITH {BLOCKS}, b AS (SELECT * FROM blocks WHERE \"index\" % 6 <> 0) SELECT doc_id, text FROM blocks WHERE block_type = 'Title' EXCEPT SELECT doc_id, text FROM b WHERE block_type = 'Title'")
def str10_titles_lost(spark, d):
    a = blocks(spark, d)
    return S.compare_blocks(a, a.filter("index % 6 <> 0"))[1]


@register(f"""WITH {CHUNKS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks), g AS (SELECT *, CASE WHEN n <= 5 THEN chunk_index ELSE (SELECT max(k) FROM unnest(range(0, 5)) t(k) WHERE (k * n) // 5 <= chunk_index) END AS g FROM n)
  SELECT doc_id, CAST(g AS INTEGER) AS chunk_index, string_agg(content, chr(10) || chr(10) ORDER BY n.chunk_index) AS content, count(*) AS merged FROM g n GROUP BY 1, 2""")
def chk3_force_cap(spark, d):
    return S.force_cap(chunks(spark, d), 5)


@register(f"WITH {CHUNKS}, r AS (SELECT doc_id, parent_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS i FROM chunks WHERE chunk_index % 2 = 0) SELECT doc_id, parent_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS children FROM r GROUP BY 1, 2")
def chk4_reindex(spark, d):
    return S.reindex(chunks(spark, d).filter("chunk_index % 2 = 0"))[1].select("doc_id", "parent_id", F.array_join("children", ",").alias("children"))


@register(f"WITH {_SIZED}, p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 900 AS pack FROM sz) SELECT doc_id, CAST(pack AS BIGINT) AS pack, count(*) AS blocks, CAST(sum(tokens) AS BIGINT) AS tokens, min(chunk_index) AS first_block FROM p GROUP BY 1, 2")
def chk5_pack_by_budget(spark, d):
    return S.pack_by_budget(sized(spark, d), 900)


@register(f"WITH {_SIZED} SELECT doc_id, count(*) AS count, round(avg(tokens), 6) AS average, round(quantile_cont(tokens, 0.5), 6) AS median, round(stddev_pop(tokens), 6) AS stdev, round(100.0 * count_if(tokens < 250) / count(*), 6) AS pct_under_250, " + ", ".join(f"count_if(tokens BETWEEN {lo} AND {hi}) AS bucket_{lo}" for _, lo, hi in S.BUCKETS) + " FROM sz GROUP BY 1")
def chk6_chunk_token_stats(spark, d):
    return S.chunk_token_stats(sized(spark, d)).select("doc_id", "count", *r6(["average", "median", "stdev", "pct_under_250"]), *[f"bucket_{lo}" for _, lo, _ in S.BUCKETS])


@register(f"WITH {_SIZED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tokens, chunk_index) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY tokens DESC, chunk_index) AS b FROM sz) SELECT doc_id, chunk_index, 'smallest' AS side, CAST(a AS INTEGER) AS place FROM r WHERE a <= 3 UNION ALL SELECT doc_id, chunk_index, 'largest', CAST(b AS INTEGER) FROM r WHERE b <= 3")
def chk7_chunk_examples(spark, d):
    return S.chunk_examples(sized(spark, d), 3).select("doc_id", "chunk_index", "side", "place")


@register(f"WITH {CHUNKS} SELECT CASE chunk_index % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'budget' ELSE 'unknown' END AS reason, count(*) AS chunks FROM chunks GROUP BY 1")
def chk8_split_reasons(spark, d):
    return S.split_reason_hist(chunks(spark, d).withColumn("reason", F.when(F.col("chunk_index") % 3 == 0, "title").when(F.col("chunk_index") % 3 == 1, "budget")))


@register()
def str2_score_headings(spark, d):
    return H.score_headings(blocks(spark, d)).select("doc_id", "index", F.round("score", 6).alias("score"), "classification", "level", "accepted", F.array_join("reject_reasons", ",").alias("reasons"))


@register()
def str6_merge_sections(spark, d):
    return L.merge_sections(sections(spark, d), near=0.05).select("doc_id", "place", "section", "level", "tokens", "parts")


@register()
def str7_pack_sections(spark, d):
    return L.pack_sections(sections(spark, d)).select("doc_id", "chunk_index", "tokens", "sections", "reason")


@register()
def chk1_adaptive_chunks(spark, d):
    return L.adaptive_chunks(elements(spark, d), 300, 100).select("doc_id", "chunk_index", "kind", "parent", "tokens", "reason")


@register()
def chk2_consolidate(spark, d):
    return L.consolidate(L.adaptive_chunks(elements(spark, d), 60, 20), cap=5).select("doc_id", "chunk_index", "kind", "parent", "tokens", "merged")


@register()
def hie2_regional_groups(spark, d):
    c = chunks(spark, d).select("doc_id", "chunk_index", F.col("section").cast("string").alias("section"), F.col("content").alias("summary"))
    return L.regional_groups(c)


@register("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def src8_event_log(spark, d):
    """Events written as JSON lines, broken lines among them, and read back."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex[:12]}"
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    D.write_events(e, path)
    e.select(F.concat(F.lit('{"event_id": '), "event_type", F.lit(', "user_id"'))).write.mode("append").text(path)
    return D.read_events(spark, path, e.schema).select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@register("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def src8_tail_events(spark, d):
    return D.tail_events(table(spark, d, "events"), 50).select("event_id", "event_type")


@register()
def str8_split_oversized(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.lit(0).alias("section"), F.lit("").alias("heading"), F.col("text").alias("body"))
    return L.split_sections(s, 100).select("doc_id", "section", "part", "tokens", F.md5("body").alias("body_md5"))
