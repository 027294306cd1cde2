"""Queries of summary checks: a document's first words are its summary; a source is a job."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import quality as Q

from .bindings import CHUNKS, chunks, pairs, table
from .registry import register

_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-zA-Z]{{3,}}'))"
_ENT = r"list_distinct(regexp_extract_all(regexp_replace({}, '[^\x00-\x7F]', '0', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z]{{2,}})\b', 1))"
#: The summary of every third document is its neighbour's, so that some pairs fail.
METRICS = rf"""p0 AS (SELECT doc_id, source AS job_id, text, regexp_split_to_array(trim(text), '\s+') AS w, (SELECT n.text FROM documents n WHERE n.doc_id = d.doc_id + 1) AS nxt FROM documents d),
pr AS (SELECT doc_id AS pair_id, job_id, text AS source, CASE WHEN doc_id % 3 = 0 AND nxt IS NOT NULL THEN left(nxt, 400) ELSE array_to_string(w[1 : greatest(1, CAST(floor(len(w) * 0.4) AS INTEGER))], ' ') END AS summary FROM p0),
t AS (SELECT *, {_TOK.format('source')} AS s, {_TOK.format('summary')} AS m, {_ENT.format('source')} AS se, {_ENT.format('summary')} AS me, list_distinct(regexp_extract_all(source, '\b\d+(?:\.\d+)?%?')) AS sn, list_distinct(regexp_extract_all(summary, '\b\d+(?:\.\d+)?%?')) AS mn, ' ' || lower(source) || ' ' AS ls, ' ' || lower(summary) || ' ' AS lm FROM pr),
u AS (SELECT *, list_filter(s, lambda x: length(x) >= 6) AS rare, len(list_intersect(s, m)) AS b, list_filter(list_sort(m)[1:40], lambda x: length(x) >= 5 AND contains(ls, x) AND contains(lm, x)) AS ck FROM t),
mt AS (SELECT pair_id, job_id, source, summary, len(sn) AS n_numbers, len(se) AS n_entities,
  CASE WHEN len(m) = 0 THEN 0.0 WHEN len(s) = 0 THEN 0.5 ELSE least(1, greatest(0, 0.6 * (b / greatest(len(m), 1)) + 0.4 * CASE WHEN len(rare) > 0 THEN len(list_intersect(m, rare)) / len(rare) ELSE b / greatest(len(m), 1) END)) END AS coverage,
  CASE WHEN len(m) = 0 THEN 1.0 ELSE (len(m) - b) / len(m) END AS hallucination,
  CASE WHEN len(ck) = 0 THEN 0.0 ELSE len(list_filter(ck, lambda x: (contains(lm, ' not ' || x) OR contains(lm, x || ' not')) AND NOT contains(ls, ' not ' || x))) / len(ck) END AS contradiction,
  CASE WHEN len(se) = 0 THEN 1.0 ELSE len(list_intersect(se, me)) / len(se) END AS entity_retention, least(1, length(summary) / greatest(1, length(source))) AS compression,
  CASE WHEN len(s) = 0 AND len(m) = 0 THEN 0.0 ELSE b / (len(s) + len(m) - b) END AS semantic, CASE WHEN len(sn) = 0 THEN 1.0 ELSE least(1, len(list_intersect(sn, mn)) / greatest(1, least(8, len(sn)))) END AS "numeric" FROM u)"""


def judged(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("job_id"), "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.substring("text", 1, 400).alias("head"))
    p = pairs(spark, d).join(docs.select("doc_id", "job_id"), "doc_id").join(nxt, "doc_id", "left")
    return p.select(F.col("doc_id").alias("pair_id"), "job_id", "source", F.when((F.col("doc_id") % 3 == 0) & F.col("head").isNotNull(), F.col("head")).otherwise(F.col("summary")).alias("summary"), F.col("head").isNotNull().alias("taken"))


def _verdicts_sql(pairs=""):
    """METRICS and what QVA4 makes of them as vd; `pairs` may put others in the place of pr."""
    return METRICS.replace("FROM pr)", f"FROM {pairs or 'pr'})") + r""",
rd AS (SELECT *, list_transform(list_filter(string_split_regex(summary, '[.!?]\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''), lambda x: list_distinct(regexp_extract_all(lower(x), '[a-zA-Z]{3,}'))) AS sets, list_filter(string_split_regex(summary, '\s+'), lambda x: x <> '') AS ws FROM mt),
re AS (SELECT *, list_filter(range(1, len(sets)), lambda i: len(sets[i]) > 0 AND len(sets[i + 1]) > 0) AS nb FROM rd),
rf AS (SELECT *, CASE WHEN len(nb) = 0 THEN 0.0 ELSE len(list_filter(nb, lambda i: len(list_intersect(sets[i], sets[i + 1])) / (len(sets[i]) + len(sets[i + 1]) - len(list_intersect(sets[i], sets[i + 1]))) > 0.7)) / len(nb) END AS redundancy,
  CASE WHEN len(ws) = 0 THEN 0.0 ELSE least(1, greatest(0, 1 - abs(list_sum(list_transform(ws, lambda x: length(x))) / len(ws) - 5.5) / 8)) END AS readability,
  least(1, greatest(0, 0.7::DOUBLE * coverage + 0.3::DOUBLE * (1 - hallucination))) AS faithfulness, least(1, greatest(0, 0.5::DOUBLE * (1 - hallucination) + 0.3::DOUBLE * (1 - contradiction) + 0.2::DOUBLE * "numeric")) AS fact_consistency FROM re),
rg AS (SELECT *, 0.26::DOUBLE * faithfulness + 0.16::DOUBLE * coverage + 0.12::DOUBLE * (1 - hallucination) + 0.08::DOUBLE * (1 - contradiction) + 0.14::DOUBLE * semantic + 0.10::DOUBLE * entity_retention + 0.08::DOUBLE * "numeric" + 0.06::DOUBLE * (1 - redundancy) AS confidence FROM rf),
vd AS (SELECT *, array_to_string(list_filter([CASE WHEN faithfulness < 0.55 THEN 'low_faithfulness' END, CASE WHEN hallucination > 0.35 THEN 'high_hallucination' END, CASE WHEN contradiction > 0.1 THEN 'contradictions' END, CASE WHEN coverage < 0.35 THEN 'low_coverage' END,
  CASE WHEN confidence < 0.6 THEN 'low_confidence' END, CASE WHEN semantic < 0.35 THEN 'low_semantic_similarity' END, CASE WHEN entity_retention < 0.4 AND n_entities >= 3 THEN 'low_entity_retention' END, CASE WHEN "numeric" < 0.25 AND n_numbers >= 3 THEN 'numerical_inconsistency' END], lambda x: x IS NOT NULL), ',') AS codes,
  faithfulness >= 0.55 AND hallucination <= 0.35 AND contradiction <= 0.1 AND confidence >= 0.6 AND semantic >= 0.35 AS passed FROM rg)"""


VERDICTS = _verdicts_sql()
#: A document's chunks, joined, against its summary.
_FINAL = _verdicts_sql("fin").replace("\nt AS (SELECT *, list_distinct", "\n" + CHUNKS + ", fin AS (SELECT pair_id, job_id, src AS source, summary FROM pr JOIN (SELECT doc_id, string_agg(content, chr(10) ORDER BY chunk_index) AS src FROM chunks GROUP BY 1) c ON c.doc_id = pr.pair_id),\nt AS (SELECT *, list_distinct", 1)

_FIGS = ["coverage", "hallucination", "contradiction", "entity_retention", "compression", "semantic"]


def r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


@register(f"WITH {METRICS} SELECT pair_id, {', '.join(f'round({c}, 6) AS {c}' for c in _FIGS)} FROM mt")
def qva1_pair_metrics(spark, d):
    return Q.pair_metrics(judged(spark, d)).select("pair_id", *r6(_FIGS))


_DENIED = METRICS.replace("' ') END AS summary FROM p0", "' ') || ' not ' || w[1] END AS summary FROM p0")


@register(f"WITH {_DENIED} SELECT pair_id, round(contradiction, 6) AS contradiction FROM mt")
def qva2_contradictions(spark, d):
    p = judged(spark, d)
    first = F.get(F.split(F.trim("source"), r"\s+"), F.lit(0))
    has_next = (F.col("pair_id") % 3 == 0) & F.col("taken")
    p = p.withColumn("summary", F.when(has_next, F.col("summary")).otherwise(F.concat("summary", F.lit(" not "), first)))
    return Q.pair_metrics(p).select("pair_id", *r6(["contradiction"]))


@register(f'WITH {METRICS} SELECT pair_id, n_numbers, round("numeric", 6) AS numeric_share FROM mt')
def qva3_numeric_consistency(spark, d):
    return Q.pair_metrics(judged(spark, d)).select("pair_id", F.col("n_numbers").cast("long").alias("n_numbers"), F.round("numeric", 6).alias("numeric_share"))


def verdicts(spark, d):
    return Q.validate_pairs(judged(spark, d))


_ALL = [*_FIGS, "redundancy", "readability", "faithfulness", "fact_consistency", "confidence"]


@register(f"WITH {VERDICTS} SELECT pair_id, job_id, {', '.join(f'round({c}, 6) AS {c}' for c in _ALL)}, codes, passed FROM vd")
def qva4_validate_pairs(spark, d):
    return verdicts(spark, d).select("pair_id", "job_id", *r6(_ALL), F.array_join("codes", ",").alias("codes"), "passed")


@register(f"WITH {VERDICTS}, g AS (SELECT job_id, count(*) AS pairs, avg(CASE WHEN passed THEN 0 ELSE 1 END) AS fail_ratio, avg(confidence) AS confidence FROM vd GROUP BY 1) SELECT job_id, pairs, round(fail_ratio, 6) AS fail_ratio, round(confidence, 6) AS confidence, fail_ratio <= 0.25 AND confidence >= 0.6 AS passed FROM g")
def qva5_aggregate_verdicts(spark, d):
    return Q.aggregate_verdicts(verdicts(spark, d)).select("job_id", "pairs", *r6(["fail_ratio", "confidence"]), "passed")


@register(f"WITH {VERDICTS} SELECT pair_id, round(confidence, 6) AS confidence, passed FROM vd")
def qva6_revalidate(spark, d):
    p = judged(spark, d)
    prior = Q.validate_pairs(p.filter("pair_id % 2 = 0")).select("pair_id", "confidence", "passed")
    changed = p.filter("pair_id % 10 = 0").select("pair_id")
    return Q.revalidate(p, prior, changed).select("pair_id", *r6(["confidence"]), "passed")


@register("SELECT doc_id AS pair_id, 0.0::DOUBLE AS confidence, 'empty_summary' AS codes, false AS passed FROM documents WHERE doc_id % 5 = 0")
def qva7_empty_summaries(spark, d):
    p = judged(spark, d).withColumn("summary", F.when(F.col("pair_id") % 5 == 0, " \n").otherwise(F.concat(F.lit("x"), "summary")))
    return Q.split_empty(p)[1].withColumn("codes", F.array_join("codes", ","))


@register(f"WITH {VERDICTS} SELECT job_id, pair_id, CAST(place AS INTEGER) AS place FROM (SELECT job_id, pair_id, row_number() OVER (PARTITION BY job_id ORDER BY round(confidence, 9), pair_id) AS place FROM vd WHERE NOT passed) WHERE place <= 2")
def qva8_pick_escalations(spark, d):
    return Q.pick_escalations(verdicts(spark, d), 2).select("job_id", "pair_id", "place")


@register(f"WITH {_FINAL} SELECT pair_id AS job_id, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, passed FROM vd")
def qva9_validate_final(spark, d):
    final = judged(spark, d).select(F.col("pair_id").alias("job_id"), "summary")
    out = Q.validate_final(chunks(spark, d).select(F.col("doc_id").alias("job_id"), "chunk_index", F.col("content").alias("summary")), final)
    return out.select(F.col("pair_id").alias("job_id"), *r6(["coverage", "confidence"]), "passed")
