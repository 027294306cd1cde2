"""Queries of features, capability scores, routing and compile trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docflow.operators import features as E
from docflow.operators import hierarchy as H
from docflow.operators import routing as R

from .bindings import CHUNKS, chunks, table
from .registry import ORACLES, register

# Phrases that give the invented lines of the documents something to find.
_PHRASES = (" therefore the algorithm x = y", " however see section 2 of the table", " because the api latency leads to it", " it shall be pursuant to clause", " according to figure 3", "", "")


def fchunks(spark, d):
    i = F.col("chunk_index")
    c = chunks(spark, d).select("doc_id", "chunk_index", "content")
    kind = F.when(i == 0, "Title").when(i % 9 == 4, "Table").when(i % 9 == 5, "List").otherwise("Text")
    path = F.when(i % 5 == 0, "Document").when(i % 5 == 1, "Methods/Data").otherwise("Appendix")
    return c.withColumn("content", F.concat("content", F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (i % 7 + 1).cast("int")))).withColumn("kind", kind).withColumn("section_path", path)


FCHUNKS = CHUNKS + f""", fc AS (SELECT doc_id, chunk_index, content || list_extract({list(_PHRASES)}, chunk_index % 7 + 1) AS content, CASE WHEN chunk_index = 0 THEN 'Title' WHEN chunk_index % 9 = 4 THEN 'Table' WHEN chunk_index % 9 = 5 THEN 'List' ELSE 'Text' END AS kind,
  CASE chunk_index % 5 WHEN 0 THEN 'Document' WHEN 1 THEN 'Methods/Data' ELSE 'Appendix' END AS section_path FROM chunks)"""


def r6(cols):
    return [F.round(c, 10).alias(c) for c in cols]


def _n(p, c="content"):
    return f"len(regexp_extract_all({c}, '{p}'))"


def _m(p, c="content"):
    return f"regexp_matches({c}, '{p}')"


@register(f"""WITH {FCHUNKS}, g AS (SELECT doc_id, avg((kind = 'Table')::INT) AS td, count_if(kind = 'Table') AS table_count, count_if(kind = 'List') AS list_count, count_if(kind = 'Title') AS title_count, avg({_m(E.IMAGE_MARK)}::INT) AS im, avg({_m(E.CHART_MARK)}::INT) AS ch, avg({_m(E.EQUATION_MARK)}::INT) AS eq, avg({_m(E.CODE_MARK)}::INT) AS co FROM fc GROUP BY 1)
  SELECT doc_id, table_count, list_count, title_count, round(td, 10) AS table_density, round(eq, 10) AS equation_density, round(least(1, greatest(0, 0.25 * (1.0 - 0.85) + 0.20 * least(1, td * 3) + 0.10 * least(1, im * 4) + 0.10 * least(1, ch * 4) + 0.15 * CASE WHEN td > 0.15 THEN 0.5 ELSE 0 END + 0.05 * least(1, eq * 3) + 0.05 * least(1, co * 3))), 10) AS structural_score FROM g""")
def fea1_structural_profile(spark, d):
    return E.structural_profile(fchunks(spark, d)).select("doc_id", "table_count", "list_count", "title_count", *r6(["table_density", "equation_density", "structural_score"]))


@register(f"""WITH {FCHUNKS}, g AS (SELECT doc_id, lower(left(string_agg(content, chr(10) ORDER BY chunk_index), 5000)) AS s, count(*) AS n, avg((kind = 'Table')::INT) AS t FROM fc GROUP BY 1),
  h AS (SELECT doc_id, n, {', '.join(_n(p, 's') + ' AS ' + k for k, p in E.DISCOURSE.items())}, least(1, t * 1.5 + CASE WHEN n < 5 THEN 0.3 ELSE 0 END) AS bias FROM g)
  SELECT doc_id, abstractive, contradiction, inference, cross_section, multi_doc, round(bias, 10) AS extractive_bias, round(least(1, greatest(0.05, 0.20 * least(1, abstractive / 8) + 0.15 * (1 - bias) + 0.15 * least(1, cross_section / 5) + 0.15 * least(1, contradiction / 5) + 0.15 * least(1, inference / 6) + 0.10 * least(1, multi_doc / 6) + 0.10 * least(1, n / 40))), 10) AS reasoning_score FROM h""")
def fea2_reasoning_profile(spark, d):
    return E.reasoning_profile(fchunks(spark, d)).select("doc_id", *E.DISCOURSE, *r6(["extractive_bias", "reasoning_score"]))


@register(f"""WITH {FCHUNKS}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) <= greatest(1, count(*) OVER (PARTITION BY doc_id) // 2) AS l FROM fc),
  t AS (SELECT doc_id, w, max(l::INT) AS l, max((NOT l)::INT) AS r FROM (SELECT doc_id, l, unnest(regexp_extract_all(lower(content), '[a-zA-Z]{{4,}}')) AS w FROM x) GROUP BY 1, 2), j AS (SELECT doc_id, sum(l * r) AS b, count(*) AS e, sum(l) AS nl, sum(r) AS nr FROM t GROUP BY 1),
  g AS (SELECT doc_id, count(*) AS chunk_count, {_n(E.CROSS_REFERENCE, "left(string_agg(content, chr(10) ORDER BY chunk_index), 6000)")} AS cr FROM fc GROUP BY 1), k AS (SELECT g.*, CASE WHEN coalesce(nl, 0) > 0 AND coalesce(nr, 0) > 0 THEN b / e ELSE 0.7 END AS c FROM g LEFT JOIN j USING (doc_id))
  SELECT doc_id, chunk_count, cr AS cross_references, round(c, 10) AS consistency, round(least(1, greatest(0, 0.35 * least(1, chunk_count / 25) + 0.25 * least(1, chunk_count / 30 + cr / 10) + 0.25 * (1 - c) + 0.15 * least(1, cr / 8))), 10) AS coherence_score FROM k""")
def fea3_coherence_profile(spark, d):
    return E.coherence_profile(fchunks(spark, d)).select("doc_id", "chunk_count", "cross_references", *r6(["consistency", "coherence_score"]))


_TOPICS = ("the patient diagnosis", "whereas this agreement", "revenue and fiscal year", "install the api endpoint", "plain words only", "regulation and compliance", "education and skills")


@register(f"""SELECT doc_id, list_extract(['medical_report', 'legal_contract', 'financial_statement', 'technical_documentation', 'general_text', 'regulatory_document', 'resume'], CAST(doc_id % 7 + 1 AS INTEGER)) AS document_type,
  list_extract(['medical', 'legal', 'financial', 'technical', 'general', 'regulatory', 'general'], CAST(doc_id % 7 + 1 AS INTEGER)) AS domain, list_extract(['high', 'high', 'high', 'medium', 'low', 'high', 'low'], CAST(doc_id % 7 + 1 AS INTEGER)) AS risk FROM documents""")
def fea4_classify_documents(spark, d):
    s = F.element_at(F.array(*[F.lit(t) for t in _TOPICS]), (F.col("doc_id") % 7 + 1).cast("int"))
    df = table(spark, d, "documents").select("doc_id", s.alias("sample"), F.lit(0.0).alias("table_density"), F.lit(0).alias("title_count"), F.lit(0).alias("multi_doc"))
    return E.classify_documents(df).select("doc_id", "document_type", "domain", "risk")


@register("""WITH v AS (SELECT label AS doc_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings) SELECT a.doc_id, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 10) AS mean_cosine, count(*) AS pairs FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.i < b.i WHERE a.i <= 8 AND b.i <= 8 GROUP BY 1""")
def fea5_retrieval_probe(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_index"), F.col("embedding").alias("vector"))
    return E.retrieval_probe(v).select("doc_id", *r6(["mean_cosine"]), "pairs")


@register("SELECT doc_id, structural_score, reasoning_score, coherence_score, chunk_count FROM " + " JOIN ".join(f"({ORACLES[k]})" + (" USING (doc_id)" if i else "") for i, k in enumerate(("fea1_structural_profile", "fea2_reasoning_profile", "fea3_coherence_profile"))))
def fea6_document_features(spark, d):
    return E.document_features(fchunks(spark, d)).select("doc_id", *r6(["structural_score", "reasoning_score", "coherence_score"]), "chunk_count")


_NOVEL = "tk AS (SELECT doc_id, chunk_index, unnest(list_distinct(regexp_extract_all(lower(content), '[a-zA-Z]{3,}'))) AS w FROM fc), fi AS (SELECT doc_id, chunk_index, count(*) AS fresh FROM (SELECT doc_id, w, min(chunk_index) AS chunk_index FROM tk GROUP BY 1, 2) GROUP BY 1, 2), sz AS (SELECT doc_id, chunk_index, len(list_distinct(regexp_extract_all(lower(content), '[a-zA-Z]{3,}'))) AS size FROM fc), nov AS (SELECT doc_id, chunk_index, CASE WHEN size = 0 THEN 0.0 ELSE coalesce(fresh, 0) / size END AS novelty FROM sz LEFT JOIN fi USING (doc_id, chunk_index))"
_FEAT = FCHUNKS + f""", {_NOVEL}, f0 AS (SELECT fc.*, novelty, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS wc, greatest(1, length(content) // 4) AS tc, {_n(E.EQUATION)} AS eq, {_n(E.FIGURE)} AS fig, CASE WHEN kind = 'Table' OR {_m(E.TABLE, 'left(content, 500)')} THEN 1 ELSE 0 END AS tab, {_n(E.TECHNICAL)} AS tech,
  len(regexp_extract_all(regexp_replace(content, '[^\\x00-\\x7F]', '0', 'g'), '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+|[A-Z]{{2,}})\\b')) AS ent, count(*) OVER (PARTITION BY doc_id) AS n, CASE WHEN kind = 'Table' OR {_m(E.TABLE, 'left(content, 400)')} THEN 'table' WHEN kind = 'List' THEN 'list' WHEN kind = 'Title' THEN 'heading' WHEN {_m(E.EQUATION)} THEN 'equation_heavy' WHEN {_m(E.LEGAL)} THEN 'legal'
  WHEN section_path = 'Appendix' THEN 'appendix' WHEN section_path LIKE 'Methods%' THEN 'technical' ELSE 'narrative' END AS st FROM fc JOIN nov USING (doc_id, chunk_index)),
f1 AS (SELECT *, least(1, ent / greatest(40.0, wc / 5.0)) AS ed, least(1, tech / greatest(8.0, wc / 80.0)) AS td, st IN ('legal', 'equation_heavy') AS hard FROM f0),
feat AS (SELECT *, least(1, greatest(0, 0.35 * least(1, tc / 1200.0) + 0.30 * td + 0.20 * least(1, eq / 5.0) + 0.15 * hard::INT)) AS complexity, least(1, greatest(0, 0.30 * ed + 0.25 * novelty + 0.20 * CASE WHEN hard OR st = 'technical' THEN 1.0 ELSE 0.4 END + 0.15 * (1 - chunk_index / greatest(1, n)) + 0.10 * least(1, tab + fig))) AS importance FROM f1)"""


@register(f"WITH {_FEAT} SELECT doc_id, chunk_index, st AS section_type, eq AS equation_count, round(td, 10) AS technical_density, round(complexity, 10) AS complexity, round(importance, 10) AS importance FROM feat")
def fea7_chunk_features(spark, d):
    return E.chunk_features(fchunks(spark, d)).select("doc_id", "chunk_index", "section_type", "equation_count", *r6(["technical_density", "complexity", "importance"]))


@register(f"WITH {FCHUNKS}, {_NOVEL} SELECT doc_id, chunk_index, round(novelty, 10) AS novelty FROM nov")
def fea8_novelty(spark, d):
    return E.novelty(fchunks(spark, d)).select("doc_id", "chunk_index", *r6(["novelty"]))


_DOMAINS, _RISKS = ("medical", "legal", "Financial", "general", "technical"), ("high", "medium", "low")


def scored(spark, d):
    k = F.col("o_orderkey")
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % len(xs) + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("doc_id"), (k % 101 / 100).alias("reasoning"), (k % 37 / 36).alias("structural"), F.when(k % 9 != 0, k % 53 / 52).alias("coherence"), (k % 29 / 28).alias("retrieval"), pick(_DOMAINS, k).alias("domain"), pick(_RISKS, k).alias("risk"), (k % 60).alias("chunk_count"))


SCORED = f"""sc AS (SELECT o_orderkey AS doc_id, (o_orderkey % 101) / 100 AS re, (o_orderkey % 37) / 36 AS st, coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 53) / 52 END, 0.3) AS co, (o_orderkey % 29) / 28 AS rt, lower(list_extract({list(_DOMAINS)}, CAST(o_orderkey % 5 + 1 AS INTEGER))) AS dm, list_extract({list(_RISKS)}, CAST(o_orderkey % 3 + 1 AS INTEGER)) AS rk, o_orderkey % 60 AS n FROM orders),
fl AS (SELECT *, least(1, greatest(0, 0.35 * re + 0.20 * st + 0.20 * co + 0.25 * (1 - rt))) AS raw, CASE dm WHEN 'medical' THEN 0.70 WHEN 'legal' THEN 0.55 WHEN 'financial' THEN 0.45 ELSE CASE rk WHEN 'high' THEN 0.45 WHEN 'medium' THEN 0.35 ELSE 0.0 END END::DOUBLE AS floor_, CASE dm WHEN 'medical' THEN 2 WHEN 'legal' THEN 1 WHEN 'financial' THEN 1 ELSE CASE rk WHEN 'low' THEN 0 ELSE 1 END END AS fr FROM sc),
cr AS (SELECT *, greatest(raw, floor_) AS crs, greatest(fr, CASE WHEN greatest(raw, floor_) < 0.35 THEN 0 WHEN greatest(raw, floor_) < 0.65 THEN 1 ELSE 2 END) AS mr FROM fl),
crs AS (SELECT *, CASE WHEN co >= 0.55 OR n >= 40 THEN 2 WHEN co >= 0.40 OR n >= 12 THEN greatest(mr, 1) ELSE mr END AS cmr FROM cr)"""
_T = "list_extract(['light', 'medium', 'heavy'], {} + 1)"


@register(f"WITH {SCORED} SELECT doc_id, round(floor_, 10) AS crs_floor, {_T.format('fr')} AS floor_tier FROM fl")
def cre1_domain_floor(spark, d):
    floor, least = R.domain_floor(F.col("domain"), F.col("risk"))
    return scored(spark, d).select("doc_id", F.round(floor, 10).alias("crs_floor"), R.tier_of(least).alias("floor_tier"))


@register(f"WITH {SCORED} SELECT doc_id, round(raw, 10) AS crs_raw, round(crs, 10) AS crs, {_T.format('mr')} AS min_tier, {_T.format('cmr')} AS compile_tier FROM crs")
def cre2_compute_crs(spark, d):
    return R.compute_crs(scored(spark, d)).select("doc_id", *r6(["crs_raw", "crs"]), "min_tier", "compile_tier")


_CATALOG = [("small-8b", "light", True, 1.0), ("small-x", "light", False, 0.5), ("mid-14b", "medium", True, 0.9), ("mid-n", "medium", False, 1.0), ("big-70b", "heavy", True, 0.8), ("big-120b", "heavy", False, 1.0)]
_MODES = ["automatic", "lowest_carbon", "Fastest", "prefer_lowest_cost"]


@register(f"""WITH {SCORED}, m AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {str(c).lower()}, {e}::DOUBLE, {R.TIERS.index(b)})" for a, b, c, e in _CATALOG)}) t(model, tier, p, av, r)),
  w AS (SELECT * FROM (VALUES (0, 0.30::DOUBLE, 0.25::DOUBLE, 0.10::DOUBLE, 0.10::DOUBLE, 0.10::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE), (1, 0.28, 0.22, 0.10, 0.05, 0.10, 0.20, 0.05), (2, 0.28, 0.20, 0.10, 0.25, 0.05, 0.02, 0.10), (3, 0.28, 0.22, 0.10, 0.08, 0.22, 0.05, 0.05)) t(k, cap, acc, rho, lat, cost, co2, avl)),
  pf AS (SELECT * FROM (VALUES (0, 0.30::DOUBLE, 0.55::DOUBLE, 0.20::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE), (1, 0.65, 0.78, 0.45, 0.45, 0.45), (2, 0.95, 0.92, 0.80, 0.85, 0.85)) t(r, c, a, l, s, g)),
  u AS (SELECT doc_id, model, tier, w.cap * CASE WHEN pf.c + 1e-6 < crs THEN greatest(0, 1 - (crs - pf.c) * 2) ELSE 1 END + acc * a + rho * rt - lat * l - cost * s - w.co2 * g * (0.5 + 0.5 * least(1, greatest(0, (300 + doc_id % 400 - 200) / 600))) + avl * av + CASE WHEN p THEN 0.02 ELSE 0 END AS utility FROM crs JOIN w ON w.k = doc_id % 4 JOIN m ON m.r >= mr JOIN pf ON pf.r = m.r),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(utility, 9) DESC, model) AS place FROM u) SELECT doc_id, model, tier, round(utility, 10) AS utility, CAST(place AS INTEGER) AS place FROM k WHERE place <= 3""")
def rte1_rank_models(spark, d):
    s = scored(spark, d)
    df = R.compute_crs(s).join(s.select("doc_id", "retrieval"), "doc_id").withColumn("intensity", F.lit(300) + F.col("doc_id") % 400).withColumn("mode", F.element_at(F.array(*[F.lit(m) for m in _MODES]), (F.col("doc_id") % 4 + 1).cast("int")))
    catalog = spark.createDataFrame(_CATALOG, "model string, tier string, is_primary boolean, availability double")
    return R.rank_models(df, catalog, 3).select("doc_id", "model", "tier", *r6(["utility"]), "place")


_ROUTE = _FEAT + """, rs AS (SELECT *, 0.35 * complexity + 0.30 * importance + 0.20 * td + 0.10 * least(1, eq / 4.0) + 0.05 * least(1, tc / 1500.0) + CASE WHEN hard THEN 0.12 ELSE 0 END AS score FROM feat),
sg AS (SELECT *, CASE WHEN score >= 0.72 OR complexity >= 0.82 AND importance >= 0.75 THEN 2 WHEN score >= 0.42 OR st IN ('technical', 'table') THEN 1 ELSE 0 END AS r0 FROM rs),
rt AS (SELECT *, CASE WHEN CASE WHEN r0 = 2 THEN 1 ELSE r0 END = 1 AND complexity < 0.55 THEN 0 ELSE CASE WHEN r0 = 2 THEN 1 ELSE r0 END END AS r FROM sg)"""


@register(f"WITH {_ROUTE} SELECT doc_id, chunk_index, round(score, 10) AS route_score, {_T.format('r0')} AS suggested FROM sg")
def rte2_suggest_tier(spark, d):
    return R.suggest_tier(E.chunk_features(fchunks(spark, d))).select("doc_id", "chunk_index", *r6(["route_score"]), "suggested")


def routes(spark, d):
    return R.route_chunks(E.chunk_features(fchunks(spark, d)), gain_min=0.03, prefer_light=True)


@register(f"WITH {_ROUTE} SELECT doc_id, chunk_index, {_T.format('r')} AS tier FROM rt")
def rte3_route_chunks(spark, d):
    return routes(spark, d).select("doc_id", "chunk_index", "tier")


@register()
def rte3_route_under_budget(spark, d):
    out = R.route_chunks(E.chunk_features(fchunks(spark, d)), budget_g=1.0)
    return out.select("doc_id", "chunk_index", "tier", "expected_carbon_g")


@register(f"WITH {_ROUTE} SELECT doc_id, count(*) AS total, count_if(r = 0) AS light, count_if(r = 1) AS medium, count_if(r = 2) AS heavy, round(sum(list_extract([0.08::DOUBLE, 0.18, 0.41], r + 1)), 10) AS predicted_g FROM rt GROUP BY 1")
def rte4_routing_distribution(spark, d):
    return R.routing_distribution(routes(spark, d)).select("doc_id", "total", "light", "medium", "heavy", *r6(["predicted_g"]))


@register("""WITH a AS (SELECT doc_id, greatest(1, doc_id % 300) AS n, greatest(50, greatest(1, length(text) // 4) // greatest(1, doc_id % 300)) AS m FROM documents), f AS (SELECT doc_id, n, greatest(2, least(24, 8160 // greatest(80, m // 4))) AS fan FROM a)
  SELECT doc_id, CAST(fan AS INTEGER) AS fan_in, CAST(CASE WHEN n <= 8 THEN 2 ELSE greatest(3, least(16, ceil(round(ln(greatest(2, n)) / ln(fan), 12)) + 2)) END AS INTEGER) AS max_depth FROM f""")
def rte6_dynamic_fan_in(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("doc_tokens"), (F.col("doc_id") % 300).alias("chunk_count"))
    return R.dynamic_fan_in(df)


@register("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'medium' ELSE 'heavy' END AS tier FROM orders")
def rte7_escalate(spark, d):
    t = F.when(F.col("o_orderstatus") == "F", "light").when(F.col("o_orderstatus") == "O", "medium").otherwise("heavy")
    return table(spark, d, "orders").select("o_orderkey", R.escalate_tier(t).alias("tier"))


@register("SELECT event_type AS model, event_id AS seq, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), 10) AS rolling_ms FROM events")
def rte9_rolling_latency(spark, d):
    return R.rolling_latency(table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"))).select("model", "seq", *r6(["rolling_ms"]))


@register(f"""WITH {_ROUTE}, x AS (SELECT doc_id, 'always_heavy' AS strategy, 2 AS r FROM rt UNION ALL SELECT doc_id, 'always_medium', 1 FROM rt UNION ALL SELECT doc_id, 'adaptive', r FROM rt)
  SELECT doc_id, strategy, round(avg(list_extract([0.88::DOUBLE, 0.95, 0.97], r + 1)), 10) AS quality, round(sum(list_extract([0.08::DOUBLE, 0.18, 0.41], r + 1)), 10) AS carbon_g, round(avg((r = 2)::INT), 10) AS heavy_share FROM x GROUP BY 1, 2""")
def rte10_compare_strategies(spark, d):
    return R.compare_strategies(routes(spark, d)).select("doc_id", "strategy", *r6(["quality", "carbon_g", "heavy_share"]))


@register(f"WITH {_ROUTE} SELECT doc_id, round(avg(list_extract([0.88::DOUBLE, 0.95, 0.97], r + 1)), 10) AS quality, round(sum(list_extract([0.08::DOUBLE, 0.18, 0.41], r + 1)), 10) AS carbon_g, round(avg(list_extract([800.0::DOUBLE, 1600, 3200], r + 1)), 10) AS latency_ms FROM rt GROUP BY 1")
def rte11_routing_expectations(spark, d):
    return R.routing_expectations(routes(spark, d)).select("doc_id", *r6(["quality", "carbon_g", "latency_ms"]))


_CALLS_NOW = 1_705_000_000.0


@register(f"""WITH RECURSIVE c AS (SELECT user_id AS endpoint, event_id AS call_id, epoch(ts) AS s, epoch(ts) + 3600 * value AS e, event_type <> 'error' AS ok, value * 10 AS lat, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value * 20 END AS ttft, CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 100 END AS tok, event_type = 'signup' AND event_id % 2 = 0 AS lim FROM events WHERE epoch(ts) <= {_CALLS_NOW}),
  o AS (SELECT endpoint, count_if(e > {_CALLS_NOW}) AS active, count_if(e <= {_CALLS_NOW}) AS calls, count_if(e <= {_CALLS_NOW} AND ok) AS good, max(CASE WHEN e <= {_CALLS_NOW} THEN greatest(CASE WHEN NOT ok THEN e + 8.0 END, CASE WHEN lim THEN e + 20.0 END) END) AS cool FROM c GROUP BY 1),
  n AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY e, call_id) AS i FROM c WHERE e <= {_CALLS_NOW}),
  w(endpoint, i, lat, ttft, tps) AS (SELECT endpoint, 0::BIGINT, 1500.0::DOUBLE, 800.0::DOUBLE, 20.0::DOUBLE FROM o UNION ALL
    SELECT w.endpoint, n.i, CASE WHEN n.lat > 0 THEN 0.8 * w.lat + 0.2 * n.lat ELSE w.lat END, CASE WHEN n.ttft > 0 THEN 0.8 * w.ttft + 0.2 * n.ttft ELSE w.ttft END, CASE WHEN tok > 0 AND n.lat > 0 THEN 0.8 * w.tps + 0.2 * (tok / greatest(0.05, n.lat / 1000.0)) ELSE w.tps END FROM w JOIN n ON n.endpoint = w.endpoint AND n.i = w.i + 1),
  l AS (SELECT endpoint, arg_max(lat, i) AS lat, arg_max(ttft, i) AS ttft, arg_max(tps, i) AS tps FROM w GROUP BY 1),
  h AS (SELECT endpoint, active, calls, round(lat, 6) AS latency_ms, round(ttft, 6) AS ttft_ms, round(tps, 6) AS tps, round(CASE WHEN cool > {_CALLS_NOW} THEN 1e9 ELSE 0.45::DOUBLE * least(1.0, active / 6.0::DOUBLE) + 0.25::DOUBLE * least(1.0, ttft / 8000) + 0.15::DOUBLE * least(1.0, greatest(0.0, 1 - tps / 40)) + 0.15::DOUBLE * CASE WHEN calls > 0 THEN 1 - good / calls ELSE 0 END END, 9) AS health FROM o JOIN l USING (endpoint))
  SELECT *, row_number() OVER (ORDER BY active, latency_ms, health, endpoint) AS place FROM h""")
def rte12_rank_endpoints(spark, d):
    k, v, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    c = table(spark, d, "events").select(
        F.col("user_id").alias("endpoint"), k.alias("call_id"), start.alias("started_s"), (start + 3600 * v).alias("ended_s"), (kind != "error").alias("ok"), (v * 10).alias("latency_ms"),
        F.when(k % 3 == 0, 0.0).otherwise(v * 20).alias("ttft_ms"), F.when(kind == "view", 0).otherwise(k % 100).alias("tokens"), ((kind == "signup") & (k % 2 == 0)).alias("rate_limited"),
    )
    return R.rank_endpoints(c, _CALLS_NOW)


@register("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'big-70b,mid-n,big-120b' ELSE 'm' || (o_orderkey % 4) || ',mid-n,big-70b,big-120b' END AS chain FROM orders")
def rte13_model_chain(spark, d):
    k = F.col("o_orderkey")
    own = F.when(k % 3 == 0, F.array(F.lit("big-70b"), F.lit("mid-n"))).otherwise(F.array().cast("array<string>"))
    df = table(spark, d, "orders").select(k.alias("doc_id"), own.alias("compile_fallbacks"), F.concat(F.lit("m"), k % 4).alias("selected_model"), F.array(F.lit("mid-n")).alias("fallbacks"))
    return R.model_chain(df, ["big-70b", "big-120b"]).select("doc_id", F.array_join("chain", ",").alias("chain"))


# Compile trees and job graphs: the lines of an order are nodes, each depending on the one before and on node 1.

_KINDS = ["chunk", "section", "chapter", "executive"]


def nodes(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    l = table(spark, d, "lineitem").withColumn("n", F.row_number().over(w))
    n, start = F.col("n"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) % 100000
    deps = F.array_distinct(F.filter(F.array(n - 1, F.when(n > 2, F.lit(1)).otherwise(F.lit(0))), lambda x: x > 0))
    return l.select(
        F.col("l_orderkey").alias("job_id"), n.alias("node_id"), deps.alias("dep_ids"), F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (n % 4 + 1).cast("int")).alias("kind"), (n % 3).alias("depth"), (F.col("l_suppkey") % 4).alias("worker_id"), F.col("l_returnflag").alias("model"),
        F.when(F.col("l_linestatus") == "O", "complete").when(F.col("l_returnflag") == "A", "error").otherwise("pending").alias("status"), F.col("l_quantity").alias("latency_ms"), (F.col("l_quantity") * 100).cast("long").alias("tokens"), (F.col("l_discount") * 10).alias("carbon_g"), F.col("l_tax").alias("cost_usd"), start.alias("start_ms"), (start + F.col("l_quantity")).alias("end_ms"),
    )


NODES = f"""nd AS (SELECT l_orderkey AS job_id, n AS node_id, list_distinct(list_filter([n - 1, CASE WHEN n > 2 THEN 1 ELSE 0 END], lambda x: x > 0)) AS deps, list_extract({_KINDS}, n % 4 + 1) AS kind, n % 3 AS depth, l_suppkey % 4 AS worker_id, l_returnflag AS model, CASE WHEN l_linestatus = 'O' THEN 'complete' WHEN l_returnflag = 'A' THEN 'error' ELSE 'pending' END AS status,
  l_quantity AS ms, CAST(l_quantity * 100 AS BIGINT) AS tokens, l_discount * 10 AS carbon_g, l_tax AS cost_usd, epoch(l_shipdate)::BIGINT % 100000 AS s, epoch(l_shipdate)::BIGINT % 100000 + l_quantity AS e FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS n FROM lineitem)),
dep AS (SELECT job_id, node_id, unnest(deps) AS dep FROM nd)"""


@register(f"WITH {CHUNKS}, g AS (SELECT doc_id, CAST(section AS VARCHAR) AS section, min(chunk_index) AS first, count(*) AS members FROM chunks GROUP BY 1, 2) SELECT doc_id, section, first, members, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) AS INTEGER) AS place FROM g")
def hie1_group_by_section(spark, d):
    c = chunks(spark, d).select("doc_id", F.col("section").cast("string").alias("section"), "chunk_index", F.col("content").alias("summary"))
    return H.group_by_section(c).select("doc_id", "section", "first", "members", "place")


_LEVELS = CHUNKS + """, lv(doc_id, level, idx, tokens, children) AS (SELECT doc_id, 0, CAST(chunk_index AS BIGINT), CAST(length(content) // 4 AS BIGINT), CAST(1 AS BIGINT) FROM chunks),
l1 AS (SELECT doc_id, 1 AS level, idx // 6 AS idx, sum(tokens)::BIGINT AS tokens, count(*) AS children FROM lv WHERE doc_id IN (SELECT doc_id FROM lv GROUP BY 1 HAVING count(*) > 6) GROUP BY 1, 3),
l2 AS (SELECT doc_id, 2 AS level, idx // 6 AS idx, sum(tokens)::BIGINT AS tokens, count(*) AS children FROM l1 WHERE doc_id IN (SELECT doc_id FROM l1 GROUP BY 1 HAVING count(*) > 6) GROUP BY 1, 3),
l3 AS (SELECT doc_id, 3 AS level, idx // 6 AS idx, sum(tokens)::BIGINT AS tokens, count(*) AS children FROM l2 WHERE doc_id IN (SELECT doc_id FROM l2 GROUP BY 1 HAVING count(*) > 6) GROUP BY 1, 3),
l4 AS (SELECT doc_id, 4 AS level, idx // 6 AS idx, sum(tokens)::BIGINT AS tokens, count(*) AS children FROM l3 WHERE doc_id IN (SELECT doc_id FROM l3 GROUP BY 1 HAVING count(*) > 6) GROUP BY 1, 3),
tree AS (SELECT * FROM lv UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4)"""


def tree(spark, d):
    return H.hierarchy_levels(chunks(spark, d).select("doc_id", F.col("chunk_index").alias("idx"), F.floor(F.length("content") / 4).alias("tokens")), 6)


@register(f"WITH {_LEVELS} SELECT doc_id, level, idx, tokens, children FROM tree")
def hie3_hierarchy_levels(spark, d):
    return tree(spark, d).select("doc_id", "level", "idx", "tokens", "children")


@register(f"WITH {_LEVELS} SELECT doc_id, level, count(*) AS nodes, round(avg(children), 10) AS mean_children, max(children) AS most_children, sum(tokens)::BIGINT AS tokens FROM tree GROUP BY 1, 2")
def hie4_hierarchy_diag(spark, d):
    return H.hierarchy_diag(tree(spark, d)).select("doc_id", "level", "nodes", *r6(["mean_children"]), "most_children", "tokens")


@register(f"WITH {NODES} SELECT job_id, node_id, CASE WHEN node_id = 2 THEN 'removed' ELSE 'rewired' END AS change FROM nd WHERE node_id IN (2, 4)")
def hie6_topology_diff(spark, d):
    n = nodes(spark, d)
    now = n.filter("node_id <> 2").withColumn("dep_ids", F.when(F.col("node_id") == 4, F.array(F.lit(1))).otherwise(F.col("dep_ids")))
    return H.topology_diff(n, now)


@register(f"WITH {NODES} SELECT job_id, kind, count_if(status = 'complete') AS complete, count_if(status = 'error') AS error, count_if(status = 'pending') AS pending FROM nd GROUP BY 1, 2")
def hie7_dag_progress(spark, d):
    return H.dag_progress(nodes(spark, d), ["complete", "error", "pending"])


@register(f"WITH {NODES} SELECT job_id, depth, worker_id, model, kind, round(sum(carbon_g), 10) AS carbon_g, sum(tokens)::BIGINT AS tokens FROM nd GROUP BY GROUPING SETS ((job_id, depth), (job_id, worker_id), (job_id, model), (job_id, kind), (job_id))")
def hie8_carbon_rollups(spark, d):
    return H.carbon_rollups(nodes(spark, d)).select("job_id", "depth", "worker_id", "model", "kind", *r6(["carbon_g"]), "tokens")


@register(f"WITH {NODES} SELECT job_id, max(c) AS critical_ms FROM (SELECT job_id, sum(ms) OVER (PARTITION BY job_id ORDER BY node_id) AS c FROM nd) GROUP BY 1")
def hie9_critical_path(spark, d):
    n = nodes(spark, d)
    return H.critical_path(n, n.select("job_id", "node_id", F.explode("dep_ids").alias("dep")))


@register(f"""WITH {NODES}, g AS (SELECT job_id, sum(ms) AS s, arg_max(node_id, ms * 1000 - node_id) AS slow FROM nd GROUP BY 1) SELECT job_id, round(least(1, s / 50 / 3), 10) AS utilization, round(s / 50, 10) AS speedup, round(s / 50 / 3, 10) AS efficiency, slow AS slowest_node FROM g""")
def hie10_dag_perf(spark, d):
    n = nodes(spark, d)
    return H.dag_perf(n, n.select("job_id").distinct().withColumn("wall_ms", F.lit(50.0)), 3).select("job_id", *r6(["utilization", "speedup", "efficiency"]), "slowest_node")


@register("""WITH o AS (SELECT event_type AS metric, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT metric, round(sum(value * pow(0.75, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.25 END), 10) AS ema, max(n) AS n FROM o GROUP BY 1""")
def hie11_planner_ema(spark, d):
    o = table(spark, d, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("seq"), "value")
    return H.planner_ema(o).select("metric", *r6(["ema"]), "n")


@register("""WITH p AS (SELECT l_orderkey AS job_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT job_id, round(greatest(1, 0.6 * greatest(1, (n + 3) // 4) * 8.0 + 0.4 * 60.0 * (n / 20.0)), 10) AS runtime_s, round(n * 0.02 * (700.0 / 500), 10) AS carbon_g, round(0.01 * (n / 20.0), 10) AS cost_usd FROM p""")
def hie12_plan_estimate(spark, d):
    p = nodes(spark, d).groupBy("job_id").agg(F.count("*").alias("compile_nodes"))
    return H.plan_estimate(p, 4, 700.0).select("job_id", *r6(["runtime_s", "carbon_g", "cost_usd"]))


@register(f"""WITH {NODES}, g AS (SELECT job_id, kind, min(s) AS f, max(e) AS l, list_position({_KINDS}, kind) AS k FROM nd GROUP BY 1, 2), x AS (SELECT job_id, kind, lead(kind) OVER w AS next_kind, lead(f) OVER w - l AS gap_ms FROM g WINDOW w AS (PARTITION BY job_id ORDER BY k)) SELECT job_id, kind, next_kind, gap_ms FROM x WHERE next_kind IS NOT NULL""")
def hie13_layer_gaps(spark, d):
    return H.layer_gaps(nodes(spark, d), _KINDS)


@register(f"""WITH {NODES} SELECT job_id, count(*) AS nodes, count_if(status = 'error') AS failed, sum(len(deps))::BIGINT AS edges, round(sum(cost_usd), 10) AS cost_usd, arg_max(node_id, ms * 1000 - node_id) FILTER (kind <> 'chunk') AS slowest_node FROM nd GROUP BY 1""")
def hie14_execution_trace(spark, d):
    return H.execution_trace(nodes(spark, d)).select("job_id", "nodes", "failed", "edges", *r6(["cost_usd"]), "slowest_node")


@register(f"""WITH {NODES}, f AS (SELECT job_id, min(s) AS f FROM nd GROUP BY 1)
  SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY s, node_id) AS INTEGER) AS place, node_id, kind, status, CAST(depth AS INTEGER) AS depth, array_to_string(list_sort(deps), ',') AS dep_ids, model, tokens, round(carbon_g, 10) AS carbon_g, ms AS latency_ms, s - f AS started_at_ms, e - f AS finished_at_ms, status = 'error' AS failed FROM nd JOIN f USING (job_id)""")
def hie14_timeline(spark, d):
    t = H.execution_timeline(nodes(spark, d))
    return t.withColumn("dep_ids", F.array_join(F.array_sort("dep_ids"), ",")).withColumn("carbon_g", F.round("carbon_g", 10))


def _submits(spark, d):
    """Each node at its start, and nodes that failed once more, three seconds after their end."""
    n = nodes(spark, d)
    return n.select("job_id", "node_id", F.col("start_ms").cast("double").alias("at_ms")).union(n.filter("status = 'error'").select("job_id", "node_id", F.col("end_ms") + 3000.0))


@register(f"""WITH {NODES}, sb AS (SELECT *, row_number() OVER (PARTITION BY job_id, node_id ORDER BY t) AS submit_n, count(*) OVER (PARTITION BY job_id, node_id) AS submits FROM (SELECT job_id, node_id, s::DOUBLE AS t FROM nd UNION ALL SELECT job_id, node_id, e + 3000.0 FROM nd WHERE status = 'error')),
  x AS (SELECT sb.job_id, sb.node_id, submit_n, submits, t, count(*) AS deps, max(CASE WHEN e <= t THEN e END) AS r, string_agg(CASE WHEN e > t THEN dep.dep END, ',' ORDER BY dep.dep) AS u FROM sb JOIN dep ON dep.job_id = sb.job_id AND dep.node_id = sb.node_id JOIN nd ON nd.job_id = sb.job_id AND nd.node_id = dep.dep GROUP BY ALL)
  SELECT job_id, node_id, CAST(submit_n AS INTEGER) AS submit_n, submits, deps, t - r AS wait_ms, CASE WHEN u IS NULL THEN '{H.QUEUED}' ELSE '{H.BLOCKED}' END AS reason, coalesce(u, '') AS unfinished FROM x WHERE t - r >= 2000""")
def hie15_wait_audit(spark, d):
    return H.wait_audit(nodes(spark, d), _submits(spark, d)).withColumn("unfinished", F.array_join("unfinished", ","))


@register(f"""WITH {NODES} SELECT dep.job_id, dep.node_id, sum(CASE WHEN status = 'complete' THEN tokens ELSE least(tokens, 400) END)::BIGINT AS prompt_tokens FROM dep JOIN nd ON nd.job_id = dep.job_id AND nd.node_id = dep.dep GROUP BY 1, 2""")
def hie16_prompt_tokens(spark, d):
    return H.prompt_tokens(nodes(spark, d))


@register(f"""WITH {NODES}, wk AS (SELECT job_id, node_id, kind, node_id % 3 AS t, worker_id / 4 AS load, tokens % 600 / 600.0::DOUBLE AS dirty, node_id % 2 = 0 AS pq FROM nd),
  ch AS (SELECT unnest([0, 1, 2]) AS place, unnest(['small-8b', 'mid-14b', 'big-70b']) AS model), lv AS (SELECT avg(value) AS ms FROM events WHERE event_type = 'click'),
  x AS (SELECT *, place / 2.0::DOUBLE AS frac, CASE WHEN t = 2 OR (t = 1 AND place = 2) OR (pq AND place = 2) THEN 3 WHEN t = 0 AND place = 0 THEN 1 ELSE 2 END AS p FROM wk, ch, lv),
  u AS (SELECT *, CASE WHEN pq OR kind IN ('executive', 'final') THEN 0.40::DOUBLE ELSE 0.30::DOUBLE END * list_extract([0.62::DOUBLE, 0.78, 0.92], p) - 0.30::DOUBLE * coalesce(CASE WHEN place = 1 THEN ms END, list_extract([800.0::DOUBLE, 1800.0, 4500.0], p)) / 5000
    - 0.25::DOUBLE * dirty * list_extract([0.08::DOUBLE, 0.22, 0.55], p) / 0.55::DOUBLE - 0.25::DOUBLE * load * frac + CASE WHEN load > 0.55 OR dirty > 0.55 THEN 0.08::DOUBLE * (1 - frac) ELSE 0 END + CASE WHEN pq AND load < 0.35 AND dirty < 0.45 THEN 0.06::DOUBLE * frac ELSE 0 END AS u FROM x)
  SELECT job_id, node_id, model, round(u, 6) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY job_id, node_id ORDER BY round(u, 9) DESC, place) AS r FROM u) WHERE r = 1""")
def rte8_assign_models(spark, d):
    n = nodes(spark, d).select("job_id", "node_id", "kind", F.element_at(F.array(*[F.lit(t) for t in R.TIERS]), (F.col("node_id") % 3 + 1).cast("int")).alias("min_tier"), (F.col("worker_id") / 4).alias("load"), (F.lit(200.0) + F.col("tokens") % 600).alias("intensity"), (F.col("node_id") % 2 == 0).alias("prefer_quality"))
    chain = spark.createDataFrame([(0, "small-8b"), (1, "mid-14b"), (2, "big-70b")], "place int, model string")
    live = table(spark, d, "events").filter("event_type = 'click'").agg(F.lit("mid-14b").alias("model"), F.avg("value").alias("rolling_ms"))
    return R.assign_models(n, chain, live).select("job_id", "node_id", "model", F.round("utility", 6).alias("utility"))


@register(f"""WITH {FCHUNKS}, g AS (SELECT doc_id, sum(greatest(1, length(content) // 4))::BIGINT AS tokens, count(*) AS chunks, count_if({_m(E.TABLE, 'left(content, 500)')} OR contains(content, '--- TABLE')) AS tables, sum({_n(E.EQUATION)})::BIGINT AS equations, count_if({_m(E.CODE_BLOCK)}) AS cb, count_if({_m(E.FIGURE, 'left(content, 400)')}) AS fg FROM fc GROUP BY 1),
  h AS (SELECT *, greatest(1, ceil(tokens / 500.0)) AS pages, least(1, (equations + cb) / (chunks * 2)) AS te, least(1, 0.15 * tables / chunks + 0.15 * fg / chunks + 0.2 * least(1, chunks / 40.0)) AS la FROM g)
  SELECT doc_id, tokens, tables, equations, round(te, 10) AS technical, CASE WHEN tokens < 2500 AND pages <= 15 AND chunks <= 8 THEN 'tiny' WHEN tokens < 12000 AND pages <= 50 AND chunks <= 25 THEN 'small' WHEN tokens < 60000 AND pages <= 200 AND chunks <= 80 THEN 'medium' WHEN tokens < 200000 AND pages <= 500 AND chunks <= 200 THEN 'large' ELSE 'xlarge' END AS document_scale,
  CASE WHEN te >= 0.75 THEN 'complex' WHEN te >= 0.45 OR la >= 0.5 THEN 'moderate' ELSE 'simple' END AS complexity_class FROM h""")
def fea9_capability_profile(spark, d):
    return E.capability_profile(fchunks(spark, d)).select("doc_id", "tokens", "tables", "equations", F.round("technical", 10).alias("technical"), "document_scale", "complexity_class")


_SCALES, _CLASSES = ("tiny", "small", "medium", "large", "xlarge"), ("simple", "moderate", "complex", "critical")


@register(f"""WITH p AS (SELECT o_orderkey AS doc_id, list_extract({list(_SCALES)}, CAST(o_orderkey % 5 + 1 AS INTEGER)) AS s, list_extract({list(_CLASSES)}, CAST(o_orderkey % 4 + 1 AS INTEGER)) AS c FROM orders), b AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v[0]}', '{v[2]}', '{v[3]}', {v[4]}::DOUBLE, {v[5]}, {v[6]}, {v[7]}::DOUBLE, {v[8]}::DOUBLE)" for k, v in R.STRATEGIES.items())}) t(s, id, ct, ve, co, es, ch, bf, gm))
  SELECT doc_id, id AS strategy_id, CASE WHEN c = 'critical' THEN 'heavy' ELSE ct END AS compile_tier, CASE WHEN c IN ('complex', 'critical') THEN 'strict' WHEN c = 'simple' AND s IN ('tiny', 'small') THEN 'light' ELSE ve END AS verification, round(CASE WHEN c IN ('complex', 'critical') THEN least(0.72, co + 0.04) ELSE co END, 10) AS confidence_at,
  CASE WHEN c IN ('complex', 'critical') THEN least(16, ch + 2) ELSE ch END AS escalated_chunks, round(bf * 0.75, 10) AS budget_factor, round(greatest(gm, 0.04), 10) AS gain_min FROM p JOIN b USING (s)""")
def rte5_select_strategy(spark, d):
    k = F.col("o_orderkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    p = table(spark, d, "orders").select(k.alias("doc_id"), pick(_SCALES).alias("document_scale"), pick(_CLASSES).alias("complexity_class"))
    return R.select_strategy(p, "eco").select("doc_id", "strategy_id", "compile_tier", "verification", F.round("confidence_at", 10).alias("confidence_at"), "escalated_chunks", F.round("budget_factor", 10).alias("budget_factor"), F.round("gain_min", 10).alias("gain_min"))


@register()
def hie5_overflow_layers(spark, d):
    e = nodes(spark, d).select("job_id", F.lit("root").alias("parent"), F.format_string("n%04d", "node_id").alias("child"), "tokens")
    return H.overflow_layers(e, 6000)
