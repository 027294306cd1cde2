"""Queries of energy and carbon accounting, over order lines as nodes and chunks of jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docflow.operators import carbon as C

from .bindings import table
from .registry import register


def nodes(spark, d):
    """A line is a node of its order's job; its flag is the tier, its quantity the tokens."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    l = table(spark, d, "lineitem").withColumn("l_linenumber", F.row_number().over(order))
    tier = F.when(F.col("l_returnflag") == "A", "light").when(F.col("l_returnflag") == "R", "large").otherwise("medium")
    return l.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("node_id"), tier.alias("tier"), (F.col("l_quantity") * 100).cast("long").alias("tokens_in"), (F.col("l_linenumber") * 10).cast("long").alias("tokens_out"), (F.lit(200.0) + 20 * (F.col("l_suppkey") % 25)).alias("intensity"), F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").alias("ts"))


NODES = """nodes AS (SELECT l_orderkey AS job_id, l_linenumber AS node_id, CASE l_returnflag WHEN 'A' THEN 'light' WHEN 'R' THEN 'heavy' ELSE 'medium' END AS tier,
  CAST(l_quantity * 100 AS BIGINT) AS tokens_in, CAST(l_linenumber * 10 AS BIGINT) AS tokens_out, 200.0::DOUBLE + 20 * (l_suppkey % 25) AS intensity, l_linestatus AS line_status FROM (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS l_linenumber) FROM lineitem)),
rates AS (SELECT * FROM (VALUES ('light', 0.85::DOUBLE, 0.5::DOUBLE, 1.4::DOUBLE, 0.0001::DOUBLE), ('medium', 1.418::DOUBLE * 3600 / 2000, 1.8::DOUBLE, 3.5::DOUBLE, 0.0004::DOUBLE), ('heavy', 6.5::DOUBLE, 4.5::DOUBLE, 9.0::DOUBLE, 0.002::DOUBLE)) t(tier, j, j_low, j_high, usd))"""


def attributed(spark, d):
    n = nodes(spark, d)
    total = n.groupBy("job_id").agg(F.sum("tokens_in").alias("input_tokens"), F.max("intensity").alias("job_intensity"))
    return n.join(total, "job_id").select("job_id", F.col("node_id").alias("chunk_index"), F.col("tokens_in").alias("tokens"), "input_tokens", C.norm_tier("tier").alias("tier"), F.col("job_intensity").alias("intensity"))


ATTRIBUTED = NODES + """, a0 AS (SELECT job_id, node_id AS chunk_index, greatest(1, tokens_in) AS weight, sum(tokens_in) OVER (PARTITION BY job_id) AS input_tokens, tier, max(intensity) OVER (PARTITION BY job_id) AS intensity FROM nodes),
a1 AS (SELECT *, CAST(greatest(floor(input_tokens * 1.25::DOUBLE), input_tokens) AS BIGINT) AS total, sum(weight) OVER (PARTITION BY job_id) AS ws FROM a0),
a2 AS (SELECT *, CAST(round_even(total * (weight / ws::DOUBLE), 0) AS BIGINT) AS share FROM a1),
a3 AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY job_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, lead(chunk_index) OVER (PARTITION BY job_id ORDER BY chunk_index) IS NULL AS is_last FROM a2),
att AS (SELECT job_id, chunk_index, a3.tier, CAST(weight AS BIGINT) AS input_tokens, CAST(CASE WHEN is_last THEN greatest(0, total - b) ELSE share END AS BIGINT) AS map_tokens, intensity, j, j_low, j_high FROM a3 JOIN rates USING (tier))"""


def jobs(spark, d):
    """Jobs with their map tokens by tier: input of the baseline and the optimised energy."""
    a = attributed(spark, d)
    tokens = C.tier_tokens(C.chunk_attribution(a))
    head = a.groupBy("job_id").agg(F.max("input_tokens").alias("input_tokens"), F.count("*").alias("chunks"), F.max("intensity").alias("intensity"))
    df = head.join(tokens, "job_id")
    df = df.withColumn("retrieved_tokens", C.retrieved_tokens(F.col("input_tokens"), F.col("chunks"), F.floor(F.try_divide(F.col("input_tokens"), F.col("chunks")))))
    df = df.withColumn("generated_tokens", F.floor(F.col("input_tokens") / 3)).withColumn("compile_tokens", F.col("generated_tokens")).withColumn("compile_tier", F.lit("heavy"))
    return df.withColumn("map_tokens", C.map_tokens(F.col("input_tokens"))).withColumn("verification_tokens", F.col("generated_tokens")).withColumn("escalated", F.col("job_id") % 3)


JOBS = ATTRIBUTED + """, jt AS (SELECT job_id, sum(input_tokens)::BIGINT AS it, count(*) AS chunks, max(intensity) AS intensity,
    sum(CASE WHEN tier = 'light' THEN map_tokens ELSE 0 END) AS lt, sum(CASE WHEN tier = 'medium' THEN map_tokens ELSE 0 END) AS mt, sum(CASE WHEN tier = 'heavy' THEN map_tokens ELSE 0 END) AS ht FROM att GROUP BY job_id),
jobs AS (SELECT job_id, it, chunks, intensity, lt, mt, ht, CAST(least(chunks, 8) * greatest(1, it // chunks) AS BIGINT) AS ret, it // 3 AS gen, CAST(greatest(floor(it * 1.25::DOUBLE), it) AS BIGINT) AS map_total, job_id % 3 AS esc FROM jt),
energy AS (SELECT *, it * 0.002::DOUBLE AS p, it * 0.003::DOUBLE AS c, it * 0.05::DOUBLE AS e, 72.0::DOUBLE + ret / 350.0::DOUBLE * 1.8::DOUBLE AS r, gen * 0.01::DOUBLE AS v FROM jobs)"""


def r6(*cols):
    return [F.round(c, 12).alias(c) for c in cols]


@register(f"WITH {NODES} SELECT job_id, node_id, round(tokens_in * j * 1.15::DOUBLE, 12) AS facility_j, round(tokens_in * j * 1.15::DOUBLE / 3600000, 12) AS energy_kwh, round(tokens_in * j * 1.15::DOUBLE / 3600000 * intensity, 12) AS co2e_g FROM nodes JOIN rates USING (tier)")
def car1_inference_energy(spark, d):
    return C.inference_energy(nodes(spark, d), "tokens_in").select("job_id", "node_id", *r6("facility_j", "energy_kwh", "co2e_g"))


_ROUTE = "54.0::DOUBLE"


@register(f"""WITH {JOBS}, x AS (SELECT job_id, unnest(['parsing', 'chunking', 'embedding', 'retrieval', 'routing', 'inference', 'verification']) AS stage,
  unnest([p, c, e, r, 0.0::DOUBLE, map_total * 6.5::DOUBLE + gen * 6.5::DOUBLE, v]) AS joules FROM energy) SELECT job_id, stage, round(joules, 12) AS joules FROM x""")
def car2_stage_energy(spark, d):
    b = C.baseline_energy(jobs(spark, d))
    long = b.unpivot(["job_id"], [f"{s}_j" for s in C.STAGES], "stage", "joules")
    return long.select("job_id", F.regexp_replace("stage", "_j$", "").alias("stage"), *r6("joules"))


_BASE = "(p + c + e + r + 0.0 + (map_total * {0} + gen * {0}) + v) * 1.15::DOUBLE / 3600000"
_GREEN = "(p + c + e + r + 54.0 + (lt * {l} + mt * {m} + ht * {h} + gen * {h}) + (v + esc * 2.0)) * 1.15::DOUBLE / 3600000"
_B = _BASE.format("6.5::DOUBLE")
_G = _GREEN.format(l="0.85::DOUBLE", m="(1.418::DOUBLE * 3600 / 2000)", h="6.5::DOUBLE")


@register(f"WITH {JOBS} SELECT job_id, round({_B}, 12) AS total_kwh, round({_B} * 3600000 / 1.15, 12) AS compute_j FROM energy")
def car3_baseline_energy(spark, d):
    return C.baseline_energy(jobs(spark, d)).select("job_id", *r6("total_kwh"), F.round("compute_j", 12).alias("compute_j"))


@register(f"WITH {JOBS} SELECT job_id, round({_G}, 12) AS total_kwh, round({_G} * 3600000 / 1.15, 12) AS compute_j FROM energy")
def car4_green_energy(spark, d):
    return C.green_energy(jobs(spark, d)).select("job_id", *r6("total_kwh"), F.round("compute_j", 12).alias("compute_j"))


@register(f"WITH {JOBS} SELECT job_id, ret AS retrieved_tokens FROM jobs")
def car5_retrieved_tokens(spark, d):
    return jobs(spark, d).select("job_id", "retrieved_tokens")


@register(f"WITH {NODES} SELECT job_id, node_id AS chunk_index, CASE WHEN line_status = 'F' THEN 'heavy' ELSE tier END AS tier FROM nodes")
def car6_final_tiers(spark, d):
    n = nodes(spark, d)
    routing = n.select("job_id", F.col("node_id").alias("chunk_index"), "tier")
    calls = n.filter("line_status = 'F'").select("job_id", F.col("node_id").alias("chunk_index"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("map").alias("phase"), F.lit("light").alias("tier")), F.struct(F.lit(2).alias("seq"), F.lit("escalate").alias("phase"), F.lit("Large").alias("tier")), F.struct(F.lit(3).alias("seq"), F.lit("compile").alias("phase"), F.lit("light").alias("tier")))).alias("x")).select("job_id", "chunk_index", "x.*")
    return C.final_tiers(routing, calls)


@register(f"WITH {ATTRIBUTED} SELECT job_id, chunk_index, tier, input_tokens, map_tokens, round(map_tokens * j * 1.15::DOUBLE / 3600000, 12) AS energy_kwh, round(map_tokens * j * 1.15::DOUBLE / 3600000 * intensity, 12) AS co2e_g FROM att")
def car7_chunk_attribution(spark, d):
    return C.chunk_attribution(attributed(spark, d)).select("job_id", "chunk_index", "tier", "input_tokens", "map_tokens", *r6("energy_kwh", "co2e_g"))


_G8 = "({} / 3600000 * intensity)"
_INF = "(map_total * 6.5::DOUBLE + gen * 6.5::DOUBLE)"
_STAGE_G = f"""SELECT job_id, it, map_total, gen, intensity, {_G8.format('p')} AS parsing_gco2e, {_G8.format('c')} AS chunking_gco2e, {_G8.format('e')} AS embedding_gco2e, {_G8.format('r')} AS retrieval_gco2e, 0.0::DOUBLE AS routing_gco2e,
  {_G8.format(_INF)} AS inference_gco2e, {_G8.format('v')} AS verification_gco2e, {_G8.format(f'((p + c + e + r + 0.0 + {_INF} + v) * (1.15::DOUBLE - 1.0::DOUBLE))')} AS infrastructure_gco2e FROM energy"""
_GRAMS = ["parsing_gco2e", "chunking_gco2e", "embedding_gco2e", "retrieval_gco2e", "routing_gco2e", "inference_gco2e", "verification_gco2e", "infrastructure_gco2e"]


@register(f"WITH {JOBS}, s AS ({_STAGE_G}) SELECT job_id, {', '.join(f'round({g}, 12) AS {g}' for g in _GRAMS)}, round({' + '.join(_GRAMS)}, 12) AS total_gco2e FROM s")
def car8_stage_co2(spark, d):
    out = C.stage_co2(C.baseline_energy(jobs(spark, d)))
    return out.select("job_id", *[F.round(g, 12).alias(g) for g in [*_GRAMS, "total_gco2e"]])


@register(f"""WITH {ATTRIBUTED}, s AS (SELECT job_id, count(*) AS total_chunks, count_if(tier = 'light') AS light_chunks, count_if(tier = 'medium') AS medium_chunks, count_if(tier = 'heavy') AS heavy_chunks,
  greatest(0, sum(map_tokens * 6.5::DOUBLE) - sum(map_tokens * j)) * 1.15 / 3600000 AS k, max(intensity) AS i FROM att GROUP BY job_id)
  SELECT job_id, total_chunks, light_chunks, medium_chunks, heavy_chunks, round(k, 12) AS kwh_saved, round(k * i, 12) AS co2e_g_saved FROM s""")
def car9_routing_impact(spark, d):
    a = attributed(spark, d)
    chunks = C.chunk_attribution(a).join(a.select("job_id", "chunk_index", "intensity"), ["job_id", "chunk_index"])
    out = C.routing_impact(chunks)
    return out.select("job_id", "total_chunks", "light_chunks", "medium_chunks", "heavy_chunks", *r6("kwh_saved"), F.round("co2e_g_saved", 12).alias("co2e_g_saved"))


def _band_sql(name, t):
    g = _GREEN.format(l=f"{t['light']}::DOUBLE", m="(1.418::DOUBLE * 3600 / 2000)" if name == "typical" else f"{t['medium']}::DOUBLE", h=f"{t['heavy']}::DOUBLE")
    return f"SELECT job_id, '{name}' AS band, round({_BASE.format(str(t['heavy']) + '::DOUBLE')} * intensity, 12) AS baseline_g, round({g} * intensity, 12) AS optimized_g FROM energy"


@register(f"WITH {JOBS} " + " UNION ALL ".join(_band_sql(n, t) for n, t in C.BANDS.items()))
def car10_uncertainty_bands(spark, d):
    out = C.uncertainty_bands(jobs(spark, d))
    return out.select("job_id", "band", F.round("baseline_g", 12).alias("baseline_g"), F.round("optimized_g", 12).alias("optimized_g"))


@register(f"""WITH {NODES}, s AS (SELECT job_id, sum(CASE WHEN line_status = 'F' THEN tokens_in + tokens_out END) AS n, sum(tokens_in) AS i FROM nodes GROUP BY job_id)
  SELECT job_id, CAST(CASE WHEN job_id % 5 = 0 THEN 1000 WHEN coalesce(n, 0) > 0 THEN n WHEN job_id % 2 = 0 THEN 500 ELSE i // 3 END AS BIGINT) AS compile_tokens FROM s""")
def car11_compile_tokens(spark, d):
    n = nodes(spark, d)
    j = n.groupBy("job_id").agg(F.sum("tokens_in").alias("input_tokens"))
    j = j.select("job_id", "input_tokens", F.when(F.col("job_id") % 5 == 0, 1000).alias("explicit_tokens"), F.when(F.col("job_id") % 2 == 0, 500).otherwise(0).alias("rollup_tokens"), F.lit(1).alias("compile_calls"))
    return C.compile_tokens(j, n.withColumn("kind", F.when(F.col("line_status") == "F", "compile").otherwise("chunk")))


@register(f"""WITH {JOBS}, s AS (SELECT job_id, {_B} AS b, {_G} AS g, intensity AS i FROM energy)
  SELECT job_id, round(b, 12) AS baseline_kwh, round(g, 12) AS actual_kwh, round(b * i, 12) AS baseline_g, round(g * i, 12) AS actual_g, round(b * i - g * i, 12) AS saved_g,
  round(CASE WHEN b > 0 THEN (b * i - g * i) / (b * i) * 100 ELSE 0 END, 12) AS efficiency_pct, CASE WHEN b * i - g * i > 0 THEN 'saving' WHEN b * i - g * i < 0 THEN 'overhead' ELSE 'neutral' END AS direction FROM s""")
def car12_workflow_carbon(spark, d):
    out = C.workflow_carbon(jobs(spark, d))
    return out.select("job_id", *r6("baseline_kwh", "actual_kwh"), *[F.round(c, 12).alias(c) for c in ("baseline_g", "actual_g", "saved_g", "efficiency_pct")], "direction")


@register(f"""WITH {NODES}, s AS (SELECT job_id * 10 + node_id AS query_id, tier, j, intensity AS i, node_id AS q, tokens_in AS ctx, tokens_in + 50 AS p, tokens_out AS o,
   CASE WHEN node_id % 2 = 0 THEN 3 ELSE CASE WHEN tokens_in > 0 THEN greatest(1, ceil(tokens_in / 350.0::DOUBLE)) ELSE 0 END END AS h FROM nodes JOIN rates USING (tier)),
  t AS (SELECT *, q * 0.05::DOUBLE AS ej, 72.0::DOUBLE + h * 1.8::DOUBLE AS rj, p * j AS pj, o * j AS oj FROM s)
  SELECT query_id, tier AS inference_tier, round(ej * 1.15 / 3600000 * i, 12) AS query_embedding_g, round(rj * 1.15 / 3600000 * i, 12) AS retrieval_g, round(pj * 1.15 / 3600000 * i, 12) AS prompt_g, round(oj * 1.15 / 3600000 * i, 12) AS completion_g,
  round((ej + rj + pj + oj) * 1.15 / 3600, 12) AS energy_wh, round((ej + rj + pj + oj) * 1.15 / 3600000 * i, 12) AS co2e_g FROM t""")
def car13_rag_query_carbon(spark, d):
    q = nodes(spark, d).select((F.col("job_id") * 10 + F.col("node_id")).alias("query_id"), F.when(F.col("tier") == "large", "heavy").otherwise(F.col("tier")).alias("tier"), "intensity", F.col("node_id").alias("query_tokens"), F.col("tokens_in").alias("context_tokens"), (F.col("tokens_in") + 50).alias("prompt_tokens"), F.col("tokens_out").alias("output_tokens"), F.when(F.col("node_id") % 2 == 0, 3).alias("hits"))
    out = C.rag_query_carbon(q)
    return out.select("query_id", "inference_tier", *r6(*[c for c in out.columns if c not in ("query_id", "inference_tier")]))


@register(f"""WITH {JOBS}, s AS ({_STAGE_G}), g AS (SELECT job_id, {_G} * intensity AS actual_g FROM energy),
  m AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in C.FRONTIER.items())}) t(model, mj)),
  x AS (SELECT s.job_id, model, mj, actual_g, infrastructure_gco2e AS inf, parsing_gco2e + chunking_gco2e + embedding_gco2e + retrieval_gco2e + routing_gco2e + verification_gco2e AS o, inference_gco2e AS was, (map_total + gen) * mj / 3600000 * intensity AS now FROM s JOIN g USING (job_id), m),
  y AS (SELECT *, o + now + CASE WHEN o + was > 0 THEN inf * ((o + now) / (o + was)) ELSE inf END AS model_g FROM x)
  SELECT job_id, model, round(model_g, 12) AS model_g, round(CASE WHEN model_g > 0 THEN (1 - actual_g / model_g) * 100 ELSE 0 END, 12) AS reduction_pct, mj IN (7.5, 6.5, 6.0) AND row_number() OVER (PARTITION BY job_id, mj ORDER BY model) = 1 AS badge FROM y""")
def car14_frontier_compare(spark, d):
    j = C.green_energy(C.stage_co2(C.baseline_energy(jobs(spark, d))), prefix="g_")
    j = j.withColumn("actual_g", F.col("g_total_kwh") * F.col("intensity")).withColumn("tokens", F.col("map_tokens") + F.col("compile_tokens"))
    out = C.frontier_compare(j)
    return out.select("job_id", "model", F.round("model_g", 12).alias("model_g"), F.round("reduction_pct", 12).alias("reduction_pct"), "badge")


@register(f"""WITH {NODES} SELECT job_id, node_id, tier, round((tokens_in + tokens_out) * j * 1.15::DOUBLE, 12) AS energy_joules, round((tokens_in + tokens_out) * j * 1.15::DOUBLE / 3600000 * intensity, 12) AS carbon_g, round((tokens_in + tokens_out) / 1000.0::DOUBLE * usd, 12) AS cost_usd FROM nodes JOIN rates USING (tier)""")
def car15_node_accounting(spark, d):
    out = C.node_accounting(nodes(spark, d).withColumn("tier", C.norm_tier("tier")))
    return out.select("job_id", "node_id", "tier", F.round("energy_joules", 12).alias("energy_joules"), *r6("carbon_g"), F.round("cost_usd", 12).alias("cost_usd"))


@register("""WITH r AS (SELECT n_nationkey AS region_id, 200.0 + 20 * n_nationkey AS intensity FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 2 = 1)
  SELECT c_custkey AS job_id, (SELECT region_id FROM r ORDER BY intensity, region_id LIMIT 1) AS region_id, CAST((SELECT min(intensity) FROM r) AS DOUBLE) AS intensity, 'carbon_optimized_selection' AS execution_status FROM customer""")
def car16_pick_region(spark, d):
    n = table(spark, d, "nation")
    regions = n.select(F.col("n_nationkey").alias("region_id"), (F.lit(200.0) + 20 * F.col("n_nationkey")).alias("intensity"), F.when(F.col("n_nationkey") % 3 != 0, "active").otherwise("planned").alias("status"), (F.col("n_nationkey") % 2 == 1).alias("supports_execution"), (F.col("n_nationkey") == 0).alias("is_default"))
    return C.pick_region(table(spark, d, "customer").select(F.col("c_custkey").alias("job_id")), regions)


@register("""WITH s AS (SELECT n_nationkey AS server_id, 100.0::DOUBLE + 10 * n_nationkey AS watts, 200.0::DOUBLE + 20 * ((n_nationkey * 7) % 25) AS intensity, 0.001::DOUBLE * (1 + n_nationkey) AS cost FROM nation),
  x AS (SELECT doc_id, server_id, watts * ((length(text) // 4 + 100) / 1000.0::DOUBLE) / 3600000.0 AS e, intensity, (length(text) // 4 + 100) / 1000.0::DOUBLE * cost AS c FROM documents, s),
  y AS (SELECT *, e * intensity AS g, row_number() OVER (PARTITION BY doc_id ORDER BY e * intensity, server_id) AS place, lead(e * intensity) OVER (PARTITION BY doc_id ORDER BY e * intensity, server_id) AS g2 FROM x)
  SELECT doc_id, server_id, round(e, 12) AS energy_kwh, round(g, 12) AS carbon_g, round(c, 12) AS cost_usd, CAST(place AS INTEGER) AS place, round(CASE WHEN place = 1 THEN g2 - g END, 12) AS saved_g FROM y""")
def car17_rank_servers(spark, d):
    k = F.col("n_nationkey")
    servers = table(spark, d, "nation").select(k.alias("server_id"), (F.lit(100.0) + 10 * k).alias("watts"), (F.lit(200.0) + 20 * ((k * 7) % 25)).alias("intensity"), (F.lit(0.001) * (1 + k)).alias("cost_per_1k"))
    docs = table(spark, d, "documents").select("doc_id", (F.floor(F.length("text") / 4) + 100).alias("tokens"))
    out = C.rank_servers(docs, servers)
    return out.select("doc_id", "server_id", F.round("energy_kwh", 12).alias("energy_kwh"), *r6("carbon_g", "cost_usd"), "place", *r6("saved_g"))


@register("""WITH e AS (SELECT event_id, 'z' || (user_id % 5) AS zone, ts FROM events WHERE event_type <> 'view'), r AS (SELECT 'z' || (user_id % 5) AS zone, ts, max(200.0 + value) AS intensity FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY 1, 2)
  SELECT event_id, round(CASE WHEN epoch_us(e.ts) - epoch_us(r.ts) <= 300000000 THEN intensity ELSE 700.0 END, 12) AS intensity, coalesce(epoch_us(e.ts) - epoch_us(r.ts) <= 300000000, false) AS fresh FROM e ASOF LEFT JOIN r ON e.zone = r.zone AND e.ts >= r.ts""")
def car18_asof_intensity(spark, d):
    e = table(spark, d, "events").withColumn("zone", F.concat(F.lit("z"), F.col("user_id") % 5))
    readings = e.filter("event_type = 'view' and value is not null").groupBy("zone", "ts").agg(F.max(F.lit(200.0) + F.col("value")).alias("intensity"))
    return C.asof_intensity(e.filter("event_type <> 'view'").select("event_id", "zone", "ts"), readings).select("event_id", *r6("intensity"), "fresh")


@register("SELECT event_id, round(value * 453.592::DOUBLE / 1000, 12) AS from_moer, round(200.0::DOUBLE + 500.0::DOUBLE * (value / 100), 12) AS from_index FROM events")
def car19_conversions(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(C.moer_to_g(F.col("value")), 12).alias("from_moer"), F.round(C.index_to_g(F.col("value")), 12).alias("from_index"))


_MODELS = ["gpt-5-nano", "gpt-5.5", "openai/gpt-oss-120b", "acme/own-8B-chat", "acme/big-70b", "unknown"]


@register(f"""WITH m AS (SELECT * FROM (VALUES ('gpt-5-nano', 0.05::DOUBLE, 0.4::DOUBLE, 'light'), ('gpt-5.5', 5.0::DOUBLE, 30.0::DOUBLE, 'heavy'), ('openai/gpt-oss-120b', 1.2::DOUBLE, 1.2::DOUBLE, 'heavy'), ('acme/own-8B-chat', 0.06::DOUBLE, 0.06::DOUBLE, 'light'), ('acme/big-70b', 0.9::DOUBLE, 0.9::DOUBLE, 'heavy'), ('unknown', 0.0::DOUBLE, 0.0::DOUBLE, 'medium')) t(model, i, o, tier)),
  n AS (SELECT l_orderkey, l_linenumber, list_extract({_MODELS}, CAST((l_orderkey + l_linenumber) % 6 + 1 AS INTEGER)) AS model, CAST(l_quantity * 100 AS BIGINT) AS p, l_linenumber * 10 AS c FROM lineitem)
  SELECT l_orderkey, l_linenumber, model, tier AS energy_tier, round(p / 1000000.0::DOUBLE * i + c / 1000000.0::DOUBLE * o, 12) AS cost_usd FROM n JOIN m USING (model)""")
def car20_api_cost(spark, d):
    l = table(spark, d, "lineitem")
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 6 + 1).cast("int"))
    l = l.select("l_orderkey", "l_linenumber", model.alias("model"), (F.col("l_quantity") * 100).cast("long").alias("p"), (F.col("l_linenumber") * 10).alias("c"))
    return l.select("l_orderkey", "l_linenumber", "model", C.energy_tier(F.col("model")).alias("energy_tier"), F.round(C.api_cost(F.col("model"), F.col("p"), F.col("c")), 12).alias("cost_usd"))
