"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import text as T

from .bindings import PAIRS, QUERY_ROWS, pairs, queries, table
from .registry import register


def _docs(spark, d):
    return table(spark, d, "documents")


@register("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS chunk_tokens, CAST(length(text) // 4 AS INTEGER) AS energy_tokens FROM documents")
def txt1_token_estimates(spark, d):
    return _docs(spark, d).select("doc_id", T.est_tokens("text").alias("chunk_tokens"), T.est_tokens0("text").alias("energy_tokens"))


_TOKENS = {k: f"regexp_extract_all(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for k, p in T.TOKEN_PATTERNS.items()}


@register("SELECT doc_id, " + ", ".join(f"len({t}) AS n_{k}, len(list_distinct({t})) AS u_{k}" for k, t in _TOKENS.items()) + " FROM documents")
def txt2_token_counts(spark, d):
    cols = [x for k in T.TOKEN_PATTERNS for x in (F.size(T.tokens("text", k)).alias(f"n_{k}"), F.size(T.token_set("text", k)).alias(f"u_{k}"))]
    return _docs(spark, d).select("doc_id", *cols)


def _jaccard_sql(pattern: str) -> str:
    a, b = (f"list_distinct(regexp_extract_all(lower({c}), '{pattern}'))" for c in ("source", "summary"))
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


@register(f"WITH {PAIRS} SELECT doc_id, round({_jaccard_sql('[a-zA-Z]{3,}')}, 6) AS alpha, round({_jaccard_sql('[a-z0-9]{3,}')}, 6) AS alnum FROM pairs")
def txt3_jaccard(spark, d):
    return pairs(spark, d).select("doc_id", F.round(T.jaccard("source", "summary", "alpha"), 6).alias("alpha"), F.round(T.jaccard("source", "summary", "alnum"), 6).alias("alnum"))


@register("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
             FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def txt4_cosine(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@register("""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{2,}') AS w FROM documents),
  s AS (SELECT doc_id, len(w) AS n, length(array_to_string(w, '')) AS c, greatest(1, length(regexp_replace(text, '[^.!?]', '', 'g'))) AS s FROM w)
  SELECT doc_id, round(CASE WHEN n = 0 THEN 0.4 ELSE least(1, greatest(0, (c / n - 4.0) / 4.0)) * 0.5 + least(1, greatest(0, (n / s - 12.0) / 16.0)) * 0.5 END, 6) AS reading_level FROM s""")
def txt5_reading_level(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.reading_level("text"), 6).alias("reading_level"))


@register("""WITH w AS (SELECT doc_id, length(text) AS c, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS n FROM documents)
  SELECT doc_id, round(CASE WHEN n = 0 THEN 0.5 ELSE least(1.5, n / (greatest(1, c) / 40.0)) END, 6) AS density FROM w""")
def txt6_density(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.density("text"), 6).alias("density"))


_ENTITIES = r"list_distinct(regexp_extract_all(regexp_replace({}, '[^\x00-\x7F]', '0', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z]{{2,}})\b', 1))"


@register("SELECT doc_id, len(e) AS n_entities, array_to_string(list_sort(e), '|') AS entities FROM (SELECT doc_id, " + _ENTITIES.format("text") + " AS e FROM documents)")
def txt7_entities(spark, d):
    e = _docs(spark, d).select("doc_id", T.entities("text").alias("e"))
    return e.select("doc_id", F.size("e").alias("n_entities"), F.array_join(F.array_sort("e"), "|").alias("entities"))


@register("SELECT doc_id, sha256(text) AS content_hash, sha256('base' || chr(10) || 'passage' || chr(10) || text) AS embed_key FROM documents")
def txt8_hashes(spark, d):
    return _docs(spark, d).select("doc_id", T.content_hash("text").alias("content_hash"), T.embed_key(F.lit("base"), F.lit("passage"), "text").alias("embed_key"))


@register("""WITH e AS (SELECT c_custkey, lower(replace(c_name, 'Customer#', 'c')) || '@Mail.example' AS email FROM customer)
  SELECT c_custkey, left(email, 1) || '***' || right(split_part(email, '@', 1), 1) || '@' || lower(split_part(email, '@', 2)) AS redacted FROM e""")
def txt9_redact_email(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", T.redact_email(F.concat(F.replace(F.lower("c_name"), F.lit("customer#"), F.lit("c")), F.lit("@Mail.example"))).alias("redacted"))


@register(r"""SELECT page_id, left(CASE WHEN n = '' THEN 'upload.bin' ELSE n END, 180) AS filename FROM
  (SELECT page_id, regexp_replace(trim(regexp_replace(split_part(url, '/', -1), '[^\p{L}\p{N}._\- ]', '_', 'g')), '^\.+', '') AS n FROM pages)""")
def txt10_safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_filename("url").alias("filename"))


@register(r"""WITH b AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM documents),
  c AS (SELECT doc_id, b, left(b, 1400) AS c FROM b),
  p AS (SELECT *, length(c) - strpos(reverse(c), ' .') - 1 AS p1, length(c) - strpos(reverse(c), ' ;') - 1 AS p2, length(c) - strpos(reverse(c), ' ,') - 1 AS p3, length(c) - strpos(reverse(c), ' ') AS p4 FROM c)
  SELECT doc_id, CASE WHEN b = '' THEN '' ELSE '## Extractive fallback' || chr(10) || chr(10) || '_Model map/escalate did not return a usable summary; using source excerpt so compile can still proceed._' || chr(10) || chr(10) ||
    CASE WHEN length(b) <= 1400 THEN b ELSE rtrim(CASE
      WHEN contains(c, '. ') AND p1 >= 700 THEN left(c, p1 + 1) WHEN contains(c, '; ') AND p2 >= 700 THEN left(c, p2)
      WHEN contains(c, ', ') AND p3 >= 700 THEN left(c, p3) WHEN contains(c, ' ') AND p4 >= 700 THEN left(c, p4) ELSE c END) || '…' END END AS summary FROM p""")
def txt11_extractive_summary(spark, d):
    return _docs(spark, d).select("doc_id", T.extractive_summary("text").alias("summary"))


@register("""SELECT event_id, props AS repaired, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE props IS NOT NULL""")
def txt12_repair_json(spark, d):
    e = table(spark, d, "events").filter("props is not null")
    raw = F.concat(F.lit("Sure:\n```json\n"), F.replace("props", F.lit("}"), F.lit(", }")), F.lit("\n```"))
    mended = T.repair_json(raw)
    return e.select("event_id", mended.alias("repaired"), F.get_json_object(mended, "$.k").cast("int").alias("k"))


@register(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || '  #' || p_brand), '[^a-z0-9_./\\+\-]+', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM part""")
def txt13_norm_label(spark, d):
    return table(spark, d, "part").select("p_partkey", T.norm_label(F.concat("p_type", F.lit("  #"), "p_brand")).alias("label"))


# Openings that turn the query rows into questions of every class.
_OPENINGS = ("Summarize", "Compare the difference between", "Explain in detail", "Give a timeline of", "Analyze the risks of", "Define", "How many", "Say a few words about all of these many things:")
_OPEN_SQL = "list_extract([" + ", ".join(f"'{o}'" for o in _OPENINGS) + f"], CAST(query_id % {len(_OPENINGS)} + 1 AS INTEGER)) || ' ' || query"


def _questions(spark, d):
    opening = F.element_at(F.array(*[F.lit(o) for o in _OPENINGS]), (F.col("query_id") % len(_OPENINGS) + 1).cast("int"))
    return queries(spark, d).select("query_id", F.concat_ws(" ", opening, "query").alias("q"))


def _plan_sql(i: int) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    whens = []
    for name, p, n, brief in T.RESPONSE_RULES:
        cond = f"regexp_matches(q, '(?i){p.replace(chr(39), chr(39) * 2)}')"
        if name == "fact":
            cond = rf"({cond} OR len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')) <= 8)"
        whens.append(f"WHEN {cond} THEN {lit((name, n, brief)[i])}")
    return f"CASE {' '.join(whens)} ELSE {lit(T.DEFAULT_RESPONSE[i])} END"


@register(f"WITH {QUERY_ROWS}, s AS (SELECT query_id, {_OPEN_SQL} AS q FROM queries) SELECT query_id, {_plan_sql(0)} AS query_type, {_plan_sql(1)} AS max_tokens, {_plan_sql(2)} AS concise FROM s")
def txt14_response_plan(spark, d):
    kind, most, brief = T.response_plan("q")
    return _questions(spark, d).select("query_id", kind.alias("query_type"), most.alias("max_tokens"), brief.alias("concise"))


@register(rf"""WITH {QUERY_ROWS}, s AS (SELECT query_id, {_OPEN_SQL} AS q FROM queries) SELECT query_id, CASE
  WHEN regexp_matches(q, '(?i)\b(summarize|summary|overview|tldr|tl;dr|sum up|brief me)\b') THEN 'summarize_excerpt'
  WHEN regexp_matches(q, '(?i)\b(timeline|chronolog|sequence of events|when did|history of events)\b') THEN 'timeline' ELSE 'qa' END AS skill FROM s""")
def txt15_intent(spark, d):
    return _questions(spark, d).select("query_id", T.classify_intent("q").alias("skill"))


_MODES = ("Auto", "max quality", "prefer-fastest ", "lowest_cost", "unheard of")


@register("""SELECT event_id, list_extract(['automatic', 'highest_quality', 'fastest', 'lowest_cost', 'automatic'], CAST(event_id % 5 + 1 AS INTEGER)) AS preference FROM events""")
def txt16_preference(spark, d):
    mode = F.element_at(F.array(*[F.lit(m) for m in _MODES]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.norm_preference(mode).alias("preference"))


@register("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status, o_orderstatus = 'F' AS terminal FROM orders""")
def txt17_status(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", F.lit(" Done")).when(F.col("o_orderstatus") == "O", F.lit("PROCESSING")).otherwise(F.lit(""))
    s = T.norm_status(raw)
    return table(spark, d, "orders").select("o_orderkey", s.alias("status"), s.isin(*T.TERMINAL).alias("terminal"))


@register("""WITH j AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS done, 7 AS total, l_linenumber * 100.0 / 7 AS p FROM lineitem)
  SELECT l_orderkey, l_linenumber, done, total, CASE WHEN l_linenumber % 2 = 1 THEN 'chunk_summaries' WHEN p >= 98 THEN 'search_ready' WHEN p >= 91 THEN 'summary_ready' WHEN p >= 90 THEN 'background'
    WHEN p >= 82 THEN 'compile' WHEN p >= 65 THEN 'validation' WHEN p >= 35 THEN 'chunk_summaries' WHEN p >= 24 THEN 'planning' WHEN p >= 20 THEN 'features' WHEN p >= 12 THEN 'triage' ELSE 'queued' END AS stage FROM j""")
def txt18_progress(spark, d):
    l = table(spark, d, "lineitem")
    message = F.concat(F.when(F.col("l_linenumber") % 2 == 1, F.lit("Summarizing... (")).otherwise(F.lit("Working (")), F.col("l_linenumber").cast("string"), F.lit(" / 7)"))
    done, total = T.progress_counts(message)
    return l.select("l_orderkey", "l_linenumber", done.alias("done"), total.alias("total"), T.progress_stage(F.col("l_linenumber") * 100.0 / 7, message).alias("stage"))


_METRICS = "\n\n## Carbon report\n\nsaved 3 g\n\n## Findings\n\nkept line\n| Model | gCO2 |\n|---|---|\n| a | 1 |\nCO2e (g) = 3\nlast line"


@register(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || '## Findings' || chr(10) || chr(10) || 'kept line' || chr(10) || 'last line' AS content FROM documents WHERE NOT contains(text, '#') AND NOT contains(text, '|')""")
def txt19_strip_metrics(spark, d):
    docs = _docs(spark, d).filter(~F.contains("text", F.lit("#")) & ~F.contains("text", F.lit("|")))
    return docs.select("doc_id", T.strip_metrics(F.concat("text", F.lit(_METRICS))).alias("content"))
