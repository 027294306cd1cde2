"""Queries of evaluation, with events as model runs and documents as answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import evaluation as E
from docflow.operators import evaluators as V

from .bindings import CHUNKS, PAIRS, chunks, pairs, table
from .registry import register


def runs(spark, d):
    e = table(spark, d, "events")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    model = F.when(F.col("event_type") == "signup", E.ROUTER).otherwise(F.col("event_type"))
    return e.select(
        i.alias("run_id"), model.alias("model"), (F.col("user_id") % 3).alias("campaign_id"), (i % 10 != 0).alias("ok"), (i % 17 == 0).alias("dry_run"), (i % 3 == 0).alias("skipped"),
        F.col("value").alias("latency_ms"), F.try_divide(k, F.col("value")).alias("tokens_per_sec"), F.when(i % 7 != 0, k).alias("prompt_tokens"), (k * 2).alias("completion_tokens"),
        (k * 0.001).alias("cost_usd"), F.when(i % 2 == 0, k * 0.002).alias("cost_upper_usd"), (F.col("value") / 10).alias("energy_wh"), (F.col("value") / 100).alias("co2e_g"), F.when(i % 5 != 0, k).cast("double").alias("quality_score"),
    )


RUNS = """runs AS (SELECT *, CASE WHEN dry_run THEN coalesce(cost_upper_usd, cost_usd) ELSE cost_usd END AS cost, CASE WHEN ok AND NOT dry_run AND NOT skipped THEN quality_score END AS q FROM (
  SELECT event_id AS run_id, CASE event_type WHEN 'signup' THEN 'intelligent-router' ELSE event_type END AS model, user_id % 3 AS campaign_id, event_id % 10 <> 0 AS ok, event_id % 17 = 0 AS dry_run, event_id % 3 = 0 AS skipped, value AS latency_ms,
  k / nullif(value, 0) AS tokens_per_sec, CASE WHEN event_id % 7 <> 0 THEN k END AS prompt_tokens, k * 2 AS completion_tokens, k * 0.001::DOUBLE AS cost_usd, CASE WHEN event_id % 2 = 0 THEN k * 0.002::DOUBLE END AS cost_upper_usd, value / 10 AS energy_wh, value / 100 AS co2e_g, CASE WHEN event_id % 5 <> 0 THEN CAST(k AS DOUBLE) END AS quality_score
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)))"""


def _models_sql(by="model"):
    return f"""SELECT {by}, count(*) AS n_runs, count_if(ok) AS n_ok, count_if(NOT ok) AS n_failed, avg(latency_ms) FILTER (ok) AS avg_latency_ms, quantile_cont(latency_ms, 0.5) FILTER (ok) AS p50_latency_ms, quantile_cont(latency_ms, 0.95) FILTER (ok) AS p95_latency_ms,
  avg(tokens_per_sec) FILTER (ok) AS avg_tokens_per_sec, avg(prompt_tokens) FILTER (ok) AS avg_prompt_tokens, avg(completion_tokens) FILTER (ok) AS avg_completion_tokens, avg(cost) FILTER (ok) AS avg_cost_usd, coalesce(sum(cost) FILTER (ok), 0) AS total_cost_usd, coalesce(sum(energy_wh) FILTER (ok), 0) AS total_energy_wh,
  avg(co2e_g) FILTER (ok) AS avg_co2e_g, coalesce(sum(co2e_g) FILTER (ok), 0) AS total_co2e_g, avg(q) AS avg_quality_score, quantile_cont(q, 0.5) AS median_quality_score, count(q) AS n_quality_scored FROM runs GROUP BY {by}"""


MODELS = RUNS + f", models AS ({_models_sql()})"
_FIGURES = ["avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "avg_tokens_per_sec", "avg_prompt_tokens", "avg_completion_tokens", "avg_cost_usd", "total_cost_usd", "total_energy_wh", "avg_co2e_g", "total_co2e_g", "avg_quality_score", "median_quality_score"]


def r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


def s6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@register(f"WITH {MODELS} SELECT model, n_runs, n_ok, n_failed, {s6(_FIGURES)}, n_quality_scored FROM models")
def evl1_per_model(spark, d):
    return E.per_model(runs(spark, d)).select("model", "n_runs", "n_ok", "n_failed", *r6(_FIGURES), "n_quality_scored")


@register(f"""WITH {RUNS}, s AS (SELECT model, q FROM runs WHERE q IS NOT NULL) SELECT count(*) AS n_scored, round(avg(q), 6) AS mean, min(q) AS min, round(quantile_cont(q, 0.25), 6) AS p25, round(quantile_cont(q, 0.5), 6) AS p50, round(quantile_cont(q, 0.75), 6) AS p75, max(q) AS max,
  (SELECT model FROM (SELECT model, avg(q) AS m FROM s GROUP BY 1) ORDER BY m DESC, model LIMIT 1) AS best_model FROM s""")
def evl2_quality_summary(spark, d):
    return E.quality_summary(runs(spark, d)).select("n_scored", *r6(["mean"]), "min", *r6(["p25", "p50", "p75"]), "max", "best_model")


@register(f"WITH {RUNS} SELECT run_id, model, q AS quality_score, latency_ms, round(cost_usd, 6) AS cost_usd, round(co2e_g, 6) AS co2e_g, round(tokens_per_sec, 6) AS tokens_per_sec FROM runs WHERE q IS NOT NULL")
def evl2_scatter(spark, d):
    return E.quality_scatter(runs(spark, d)).select("run_id", "model", "quality_score", "latency_ms", *r6(["cost_usd", "co2e_g", "tokens_per_sec"]))


_SETS = PAIRS + r""", p0 AS (SELECT doc_id, source, summary, regexp_extract_all(lower(source), '[a-z0-9]+(?:''[a-z]+)?') AS rl, regexp_extract_all(lower(summary), '[a-z0-9]+(?:''[a-z]+)?') AS cl,
  regexp_replace(trim(lower(source)), '\s+', ' ', 'g') AS rn, regexp_replace(trim(lower(summary)), '\s+', ' ', 'g') AS cn FROM pairs),
p1 AS (SELECT *, list_distinct(rl) AS r, list_distinct(cl) AS c FROM p0), p2 AS (SELECT *, len(list_intersect(r, c)) AS b, CASE WHEN len(rl) = 0 THEN length(rn) ELSE len(rl) END AS rlen, CASE WHEN len(cl) = 0 THEN length(cn) ELSE len(cl) END AS clen FROM p1)"""
_RECALL = "CASE WHEN len(r) = 0 THEN CASE WHEN len(c) = 0 THEN 100.0 ELSE 50.0 END WHEN len(c) = 0 THEN 0.0 ELSE 100.0 * b / len(r) END"
_F1 = "CASE WHEN len(r) = 0 AND len(c) = 0 THEN 100.0 WHEN len(r) = 0 OR len(c) = 0 THEN 0.0 ELSE 2 * (b / len(c)) * (b / len(r)) / greatest(1e-9, b / len(c) + b / len(r)) * 100 END"
_RATIO = "CASE WHEN rlen <= 0 AND clen <= 0 THEN 100.0 WHEN clen <= 0 THEN 0.0 WHEN rlen <= 0 THEN greatest(0, 100.0 - least(80.0, clen * 2.0)) WHEN clen / rlen BETWEEN 0.6 AND 1.4 THEN 100.0 WHEN clen / rlen < 0.6 THEN 100.0 * (clen / rlen / 0.6) ELSE 100.0 * (1.4 / (clen / rlen)) END"


@register(f"WITH {_SETS} SELECT doc_id, CASE WHEN rn = cn THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match, round({_RECALL}, 6) AS token_recall, round({_RATIO}, 6) AS length_ratio, round({_F1}, 6) AS token_f1 FROM p2")
def evl3_lexical_scores(spark, d):
    return E.lexical_scores(pairs(spark, d), "source", "summary").select("doc_id", "exact_match", *r6(["token_recall", "length_ratio", "token_f1"]))


def answers(spark, d):
    """Neighbouring turns of a conversation as reference and candidate."""
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    return c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("reference"), "candidate", F.concat_ws(" ", "text", "role").alias("context"))


@register()
def evl4_sequence_similarity(spark, d):
    return answers(spark, d).select("pair_id", F.round(E.sequence_similarity("reference", "candidate"), 6).alias("similarity"))


@register(r"""WITH a AS (SELECT c.conv_id * 1000 + c.turn AS pair_id, n.text AS cand, c.text || ' ' || c.role AS ctx FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1),
  s AS (SELECT pair_id, lower(cand) AS low, ctx, regexp_extract_all(lower(cand), '[a-z0-9]+(?:''[a-z]+)?') AS w, list_distinct(regexp_extract_all(lower(ctx), '[a-z0-9]+(?:''[a-z]+)?')) AS x, regexp_replace(trim(lower(ctx)), '\s+', ' ', 'g') AS cn FROM a),
  t AS (SELECT *, list_distinct(w) AS c, len(list_filter(range(1, len(w) - 1), lambda i: contains(cn, array_to_string(w[i : i + 2], ' ')))) AS hits FROM s)
  SELECT pair_id, round(CASE WHEN trim(ctx) = '' THEN NULL WHEN len(c) = 0 OR len(x) = 0 THEN 0.0 ELSE 100.0 * least(1.0, len(list_intersect(c, x)) / len(c) + CASE WHEN contains(low, '[') OR contains(low, 'source') OR contains(low, 'according to') OR contains(low, 'as stated') OR contains(low, 'cited') THEN 0.08 ELSE 0 END + least(0.15, hits * 0.03)) END, 6) AS grounding FROM t""")
def evl5_grounding(spark, d):
    return answers(spark, d).select("pair_id", F.round(E.grounding("candidate", "context"), 6).alias("grounding"))


@register()
def evl6_composite(spark, d):
    return E.composite(answers(spark, d)).select("pair_id", "skipped", *r6(["quality_score", "correctness", "completeness", "groundedness", "conciseness"]), "note")


def _high(name, metric, way):
    return f"SELECT '{name}' AS highlight, model, round({metric}, 6) AS value FROM (SELECT * FROM models WHERE {metric} IS NOT NULL ORDER BY {metric} {'ASC' if way == 'min' else 'DESC'}, model LIMIT 1)"


@register(f"WITH {MODELS} " + " UNION ALL ".join(_high(n, *mw) for n, mw in E.HIGHLIGHTS.items()))
def evl7_highlights(spark, d):
    return E.highlights(E.per_model(runs(spark, d))).select("highlight", "model", *r6(["value"]))


@register(f"""WITH {MODELS}, b AS (SELECT * FROM models WHERE avg_quality_score IS NOT NULL ORDER BY avg_quality_score DESC, model LIMIT 1), r AS (SELECT * FROM models WHERE model = 'intelligent-router')
  SELECT b.model AS best_model, round(r.avg_quality_score / b.avg_quality_score * 100, 6) AS quality_pct, round((1 - r.total_cost_usd / b.total_cost_usd) * 100, 6) AS cost_less_pct, round((1 - r.avg_latency_ms / b.avg_latency_ms) * 100, 6) AS latency_less_pct, round((1 - r.avg_co2e_g / b.avg_co2e_g) * 100, 6) AS co2e_less_pct FROM r, b""")
def evl8_quality_insights(spark, d):
    return E.quality_insights(E.per_model(runs(spark, d))).select("best_model", *r6(["quality_pct", "cost_less_pct", "latency_less_pct", "co2e_less_pct"]))


_CHARTS = {"avg_latency_ms": "latency", "p50_latency_ms": "latency", "p95_latency_ms": "latency", "avg_prompt_tokens": "tokens", "avg_completion_tokens": "tokens", "avg_cost_usd": "cost", "total_cost_usd": "cost", "avg_co2e_g": "co2e", "total_co2e_g": "co2e", "avg_quality_score": "quality", "median_quality_score": "quality"}


@register(f"WITH {MODELS} " + " UNION ALL ".join(f"SELECT '{c}' AS chart, model, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value FROM models" for m, c in _CHARTS.items()))
def evl9_dashboard_series(spark, d):
    return E.dashboard_series(E.per_model(runs(spark, d))).select("chart", "model", "metric", *r6(["value"]))


@register("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'added' ELSE 'changed' END AS state FROM documents WHERE doc_id % 11 = 0 AND doc_id % 13 <> 0 OR doc_id % 13 = 0 AND doc_id % 11 <> 0 OR doc_id % 7 = 0 AND doc_id % 11 <> 0""")
def evl10_verify_frozen(spark, d):
    docs = table(spark, d, "documents")
    was = E.freeze(docs.filter("doc_id % 13 <> 0"), "doc_id", ["text", "source"])
    now = E.freeze(docs.filter("doc_id % 11 <> 0").withColumn("source", F.when(F.col("doc_id") % 7 == 0, "moved").otherwise(F.col("source"))), "doc_id", ["text", "source"])
    return E.verify_frozen(was, now, "doc_id")


@register("""WITH j AS (SELECT o_orderkey AS job_id, o_orderdate AS made, 'doc' || (o_custkey % 50) || '.pdf' AS b FROM orders) SELECT 'in/Doc' || n || '.PDF' AS name, (SELECT job_id FROM j WHERE b = 'doc' || n || '.pdf' ORDER BY made DESC, job_id DESC LIMIT 1) AS job_id FROM (SELECT n_nationkey * 3 AS n FROM nation)""")
def evl12_resolve_document(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("a/b/doc"), F.col("o_custkey") % 50, F.lit(".pdf")).alias("file_name"))
    names = table(spark, d, "nation").select(F.concat(F.lit("in/Doc"), F.col("n_nationkey") * 3, F.lit(".PDF")).alias("name"))
    return E.resolve_document(jobs, names)


def campaigns(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    w = E.campaign_workload(F.when(k % 5 == 0, "document_summarization"), F.when(k % 3 == 0, "Summarization-long").otherwise("standard"))
    return o.select(k.alias("campaign_id"), F.col("o_orderdate").alias("at"), F.when(k % 4 == 0, "FAILED").otherwise("done").alias("status"), (k % 6 == 1).alias("dry_run"), F.when(k % 7 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("cost_usd"), F.lit(0.5).alias("runtime_s"), F.col("o_custkey").alias("document_id"), w.alias("workload"))


_CAMPAIGNS = """c AS (SELECT o_orderkey AS campaign_id, o_orderdate AS made, o_custkey AS document_id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'document_summarization' ELSE 'interactive_rag' END AS workload FROM orders WHERE o_orderkey % 4 <> 0 AND (o_orderkey % 6 = 1 OR o_orderkey % 7 <> 0 AND o_totalprice > 0))"""


@register(f"WITH {_CAMPAIGNS} SELECT workload, arg_max(campaign_id, row(made, campaign_id)) AS campaign_id FROM c GROUP BY 1")
def evl13_pick_campaigns(spark, d):
    return E.pick_campaigns(campaigns(spark, d))


@register(f"WITH {_CAMPAIGNS} SELECT r.campaign_id AS rag, s.campaign_id AS summarization FROM c r JOIN c s USING (document_id) WHERE r.workload = 'interactive_rag' AND s.workload = 'document_summarization' ORDER BY r.made DESC, r.campaign_id DESC, s.made DESC, s.campaign_id DESC LIMIT 1")
def evl13_cross_workload_pair(spark, d):
    return E.cross_workload_pair(campaigns(spark, d))


@register(f"WITH {RUNS}, m AS ({_models_sql('campaign_id, model')}) SELECT campaign_id, round(sum(CASE WHEN model = 'click' THEN avg_co2e_g * greatest(1, n_ok) ELSE total_co2e_g END), 6) AS co2e_g, round(sum(total_cost_usd), 6) AS cost_usd FROM m GROUP BY 1")
def evl14_campaign_totals(spark, d):
    m = E.per_model(runs(spark, d), ("campaign_id", "model")).withColumn("total_co2e_g", F.when(F.col("model") != "click", F.col("total_co2e_g")))
    return E.campaign_totals(m).select("campaign_id", *r6(["co2e_g", "cost_usd"]))


@register(f"""WITH {MODELS}, x AS (SELECT min(avg_latency_ms) AS l0, max(avg_latency_ms) AS l1, min(total_cost_usd) AS c0, max(total_cost_usd) AS c1, min(avg_co2e_g) AS g0, max(avg_co2e_g) AS g1, min(avg_tokens_per_sec) AS t0, max(avg_tokens_per_sec) AS t1 FROM models)
  SELECT model, round((l1 - avg_latency_ms) / (l1 - l0) * 100, 6) AS speed, round((c1 - total_cost_usd) / (c1 - c0) * 100, 6) AS cost, round((g1 - avg_co2e_g) / (g1 - g0) * 100, 6) AS carbon, round((avg_tokens_per_sec - t0) / (t1 - t0) * 100, 6) AS throughput FROM models, x""")
def evl15_tradeoff(spark, d):
    return E.tradeoff(E.per_model(runs(spark, d))).select("model", *r6(["speed", "cost", "carbon", "throughput"]))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'document_summarization' ELSE 'interactive_rag' END AS workload FROM orders")
def evl16_suite_workload(spark, d):
    return campaigns(spark, d).select(F.col("campaign_id").alias("o_orderkey"), "workload")


@register(f"""WITH {MODELS} SELECT model FROM models m WHERE NOT EXISTS (SELECT 1 FROM models o WHERE o.avg_quality_score >= m.avg_quality_score AND o.avg_latency_ms <= m.avg_latency_ms AND o.total_cost_usd <= m.total_cost_usd AND o.avg_co2e_g <= m.avg_co2e_g
  AND (o.avg_quality_score > m.avg_quality_score OR o.avg_latency_ms < m.avg_latency_ms OR o.total_cost_usd < m.total_cost_usd OR o.avg_co2e_g < m.avg_co2e_g))""")
def evl17_pareto(spark, d):
    return E.pareto(E.per_model(runs(spark, d))).select("model")


@register("SELECT count(*) AS n, round(quantile_cont(s, 0.5), 6) AS median_speedup, round(max(s), 6) AS best_speedup FROM (SELECT l_extendedprice / l_quantity AS s FROM lineitem WHERE l_quantity > 0)")
def evl18_speedup_summary(spark, d):
    out = E.speedup_summary(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("sequential_ms"), F.col("l_quantity").alias("parallel_ms")))
    return out.select("n", *r6(["median_speedup", "best_speedup"]))


@register(f"""WITH {CHUNKS}, w AS (SELECT *, coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM chunks WHERE chunk_index < 6)
  SELECT doc_id, count(*) AS chunks, left(string_agg(left(content, CAST(600 - f AS INTEGER)), chr(10) || chr(10) ORDER BY chunk_index), 600) AS window_text FROM w WHERE f < 600 GROUP BY doc_id""")
def evl19_freeze_window(spark, d):
    return E.freeze_window(chunks(spark, d), 6, 600)


@register(f"""WITH {MODELS} SELECT 'interactive_rag' AS workload, model, round(total_cost_usd, 6) AS cost_usd, round(total_co2e_g, 6) AS co2e_g FROM models UNION ALL SELECT 'document_summarization', model, round(total_cost_usd, 6), round(total_co2e_g, 6) FROM models WHERE model <> 'click'""")
def evl20_workload_points(spark, d):
    m = E.per_model(runs(spark, d))
    return E.workload_points(m, m.filter("model <> 'click'")).select("workload", "model", *r6(["cost_usd", "co2e_g"]))


def _labelled_pairs(spark, d):
    """Documents beside their first words, with their label where there is one."""
    known = table(spark, d, "labels").select(F.col("doc_id").alias("pair_id"), "quality")
    return pairs(spark, d).select(F.col("doc_id").alias("pair_id"), F.col("source").alias("reference"), F.col("summary").alias("candidate"), F.col("source").alias("context")).join(known, "pair_id", "left")


_SCORED = f"""WITH {_SETS}, sc AS (SELECT doc_id AS pair_id, 'lexical' AS evaluator, trim(source) = '' AS skipped, CASE WHEN trim(source) <> '' THEN {_F1} END AS quality_score, 'token f1' AS note FROM p2
  UNION ALL SELECT d.doc_id, 'labelled', quality IS NULL, 100.0::DOUBLE * quality, 'label' FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@register(_SCORED + " SELECT evaluator, pair_id, skipped, round(quality_score, 6) AS quality_score, note FROM sc")
def evl_registered_evaluators(spark, d):
    """Named evaluators over the same pairs."""
    return V.evaluate(_labelled_pairs(spark, d), "lexical", "labelled").select("evaluator", "pair_id", "skipped", *r6(["quality_score"]), "note")


@register(_SCORED + " SELECT a.evaluator AS first, b.evaluator AS second, count(*) AS pairs, round(avg(b.quality_score - a.quality_score), 6) AS mean_difference FROM sc a JOIN sc b ON a.pair_id = b.pair_id AND a.evaluator < b.evaluator WHERE NOT a.skipped AND NOT b.skipped GROUP BY 1, 2")
def evl_compared_evaluators(spark, d):
    return V.compare_evaluators(V.evaluate(_labelled_pairs(spark, d), "lexical", "labelled")).select("first", "second", "pairs", *r6(["mean_difference"]))
