"""Energy and CO2e accounting of jobs, chunks, nodes and queries.

Tables in, tables out; rates are small fixed dimensions, so tiers, price lists, bands and models are
literal columns or cross joins with a handful of rows. Missing numbers count as 0 and negatives as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Joules per kWh, facility overhead, joules per token and stage, token prices.
JOULES_PER_KWH = 3_600_000.0
PUE = 1.15
J_TYPICAL = {"light": 0.85, "medium": 1.418 * 3600.0 / 2000.0, "heavy": 6.5, "large": 6.5}
J_LOW = {"light": 0.50, "medium": 1.80, "heavy": 4.50, "large": 4.50}
J_HIGH = {"light": 1.40, "medium": 3.50, "heavy": 9.00, "large": 9.00}
BANDS = {"low": J_LOW, "typical": J_TYPICAL, "high": J_HIGH}
PARSING_J, CHUNKING_J, EMBEDDING_J, VERIFY_J = 0.002, 0.003, 0.05, 0.01
RETRIEVAL_BASE_J, RETRIEVAL_HIT_J, ROUTING_BASE_J, ESCALATION_J = 72.0, 1.8, 54.0, 2.0
RETRIEVED_CAP, CHUNK_TOKENS = 8, 350
COST_PER_1K = {"light": 0.0001, "medium": 0.0004, "heavy": 0.0020}
FRONTIER = {
    "GPT-o3": 7.5, "GPT-4": 6.5, "Llama 4 Behemoth": 6.5, "Claude 4 Opus": 6.0,
    "GPT-4o": 4.0, "Gemini 2.5 Pro": 3.8, "Llama 4 Maverick": 2.8, "Gemma 3": 1.6,
}
API_PRICES = {
    "gpt-5-nano": (0.05, 0.40), "gpt-5-mini": (0.25, 2.00), "gpt-5.5": (5.00, 30.00),
    "meta/llama-3.1-8b-instruct": (0.06, 0.06), "meta/llama-3.3-70b-instruct": (0.90, 0.90),
    "mistralai/ministral-14b-instruct-2512": (0.20, 0.20), "mistralai/mistral-nemotron": (0.15, 0.15), "openai/gpt-oss-120b": (1.20, 1.20),
}
ENERGY_TIERS = {
    "gpt-5-nano": "light", "gpt-5-mini": "medium", "gpt-5.5": "heavy", "meta/llama-3.1-8b-instruct": "light",
    "mistralai/mistral-nemotron": "light", "mistralai/ministral-14b-instruct-2512": "medium",
    "meta/llama-3.3-70b-instruct": "heavy", "openai/gpt-oss-120b": "heavy", "intelligent-router": "medium",
}
TIERS = ("light", "medium", "heavy")
STAGES = ("parsing", "chunking", "embedding", "retrieval", "routing", "inference", "verification")
FALLBACK_INTENSITY, READING_TTL_S = 700.0, 300


def count(c) -> Column:
    return F.greatest(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)), F.lit(0))


def kwh(joules: Column) -> Column:
    return joules / JOULES_PER_KWH


def facility(joules: Column) -> Column:
    return joules * PUE


def rate(tier: Column, table: dict[str, float] = J_TYPICAL, default: str = "heavy") -> Column:
    """Joules per token of a tier; an unknown or missing tier has the baseline's."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(tier)), F.lit(table[default]))


def norm_tier(c, default: str | None = "medium") -> Column:
    t = F.lower(F.col(c) if isinstance(c, str) else c)
    t = F.when(t == "large", F.lit("heavy")).otherwise(t)
    return F.when(t.isin(*TIERS), t).otherwise(F.lit(default))


def inference_energy(df: DataFrame, tokens: str = "tokens", tier: str = "tier", intensity: str = "intensity") -> DataFrame:
    """CAR1: adds joules, facility_j, energy_kwh, co2e_g of tokens processed at a tier."""
    j = count(tokens) * rate(F.col(tier))
    return df.withColumn("joules", j).withColumn("facility_j", facility(j)).withColumn("energy_kwh", kwh(facility(j))).withColumn("co2e_g", kwh(facility(j)) * F.col(intensity))


def retrieved_tokens(input_tokens: Column, chunks: Column, mean_tokens: Column) -> Column:
    """CAR5: tokens of the chunks that count as retrieved, eight at most."""
    mean = F.when((mean_tokens <= 0) & (chunks > 0) & (input_tokens > 0), F.greatest(F.lit(1), F.floor(input_tokens / F.greatest(F.lit(1), chunks)))).otherwise(mean_tokens)
    mean = F.when(mean == 0, F.lit(CHUNK_TOKENS)).otherwise(mean)
    return (F.least(F.greatest(F.lit(1), F.coalesce(chunks, F.lit(1))), F.lit(RETRIEVED_CAP)) * F.greatest(F.lit(1), mean)).cast("long")


def map_tokens(input_tokens: Column) -> Column:
    return F.when(input_tokens > 0, F.greatest(F.floor(input_tokens * 1.25), input_tokens)).otherwise(F.lit(0)).cast("long")


def stage_joules(routing: float, map_j: Column, compile_j: Column, escalated: Column | None = None) -> dict[str, Column]:
    """CAR2: joules by stage from input_tokens, retrieved_tokens and verification_tokens."""
    n = count("input_tokens")
    verify = count("verification_tokens") * VERIFY_J
    return {
        "parsing": n * PARSING_J, "chunking": n * CHUNKING_J, "embedding": n * EMBEDDING_J,
        "retrieval": F.lit(RETRIEVAL_BASE_J) + count("retrieved_tokens") / CHUNK_TOKENS * RETRIEVAL_HIT_J,
        "routing": F.lit(routing), "inference": map_j + compile_j,
        "verification": verify if escalated is None else verify + count(escalated) * ESCALATION_J,
    }


def with_stages(df: DataFrame, joules: dict[str, Column], prefix: str = "") -> DataFrame:
    df = df.withColumns({f"{prefix}{s}_j": joules[s] for s in STAGES})
    total = sum((F.col(f"{prefix}{s}_j") for s in STAGES[1:]), F.col(f"{prefix}{STAGES[0]}_j"))
    df = df.withColumn(f"{prefix}compute_j", total)
    df = df.withColumn(f"{prefix}facility_j", facility(F.col(f"{prefix}compute_j")))
    df = df.withColumn(f"{prefix}infrastructure_j", F.greatest(F.lit(0.0), F.col(f"{prefix}facility_j") - F.col(f"{prefix}compute_j")))
    return df.withColumn(f"{prefix}total_kwh", kwh(F.col(f"{prefix}facility_j")))


def baseline_energy(jobs: DataFrame, j_per_token: float | None = None, prefix: str = "") -> DataFrame:
    """CAR3: one frontier model for all map and compile tokens of a job."""
    j = j_per_token if j_per_token is not None else J_TYPICAL["heavy"]
    m = F.coalesce(F.col("map_tokens"), map_tokens(count("input_tokens")))
    c = count(F.coalesce(F.col("compile_tokens"), F.col("generated_tokens")))
    return with_stages(jobs, stage_joules(0.0, m * j, c * j), prefix)


def green_energy(jobs: DataFrame, table: dict[str, float] = J_TYPICAL, prefix: str = "") -> DataFrame:
    """CAR4: jobs with light, medium and heavy map tokens, compile_tokens, compile_tier, escalated."""
    map_j = sum((count(f"{t}_tokens") * table[t] for t in TIERS[1:]), count("light_tokens") * table["light"])
    compile_j = count("compile_tokens") * rate(F.col("compile_tier"), table)
    return with_stages(jobs, stage_joules(ROUTING_BASE_J, map_j, compile_j, F.col("escalated")), prefix)


def tier_tokens(chunks: DataFrame, key: str = "job_id") -> DataFrame:
    """Map tokens of a job by tier, one row a job (sums with map-side combine)."""
    return chunks.groupBy(key).agg(*[F.sum(F.when(F.col("tier") == t, F.col("map_tokens")).otherwise(0)).alias(f"{t}_tokens") for t in TIERS])


def final_tiers(routing: DataFrame, telemetry: DataFrame, default: str = "medium") -> DataFrame:
    """CAR6: (job_id, chunk_index, tier): the last map or escalation record wins over the route."""
    known = F.lower("tier").isin(*TIERS, "large")
    t = telemetry.filter(F.col("phase").isin("map", "escalate") & known)
    t = t.groupBy("job_id", "chunk_index").agg(F.max_by(norm_tier("tier"), "seq").alias("last"))
    r = routing.filter("chunk_index >= 0").select("job_id", "chunk_index", norm_tier("tier", default).alias("routed"))
    return r.join(t, ["job_id", "chunk_index"], "full").select("job_id", "chunk_index", F.coalesce("last", "routed").alias("tier"))


def chunk_attribution(chunks: DataFrame, intensity: str = "intensity") -> DataFrame:
    """CAR7: a job's map tokens shared over its chunks by their tokens, the last taking the rest.

    chunks: job_id, chunk_index, tokens (a chunk's estimate), input_tokens (the job's), tier, intensity.
    """
    w = F.greatest(F.lit(1), F.col("tokens"))
    job = Window.partitionBy("job_id")
    order = job.orderBy("chunk_index")
    df = chunks.withColumn("weight", w).withColumn("total", map_tokens(F.col("input_tokens")))
    df = df.withColumn("share", F.rint(F.col("total") * (F.col("weight") / F.sum("weight").over(job).cast("double"))).cast("long"))
    before = F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("chunk_index").over(order).isNull()
    df = df.withColumn("map_tokens", F.when(last, F.greatest(F.lit(0), F.col("total") - before)).otherwise(F.col("share")))
    j = facility(F.col("map_tokens") * rate(F.col("tier"), default="medium"))
    return df.select("job_id", "chunk_index", "tier", F.col("weight").alias("input_tokens"), "map_tokens", j.alias("energy_joules"), kwh(j).alias("energy_kwh"), (kwh(j) * F.col(intensity)).alias("co2e_g"))


def stage_co2(df: DataFrame, prefix: str = "", intensity: str = "intensity") -> DataFrame:
    """CAR8: grams by stage without overhead, and the overhead's as infrastructure."""
    g = {s: kwh(F.col(f"{prefix}{s}_j")) * F.col(intensity) for s in STAGES}
    g["infrastructure"] = kwh(F.col(f"{prefix}compute_j") * (PUE - 1.0)) * F.col(intensity)
    df = df.withColumns({f"{s}_gco2e": x for s, x in g.items()})
    return df.withColumn("total_gco2e", sum((F.col(f"{s}_gco2e") for s in list(g)[1:]), F.col(f"{list(g)[0]}_gco2e")))


def routing_impact(chunks: DataFrame, intensity: str = "intensity") -> DataFrame:
    """CAR9: chunks of a job by tier, and what its map saves against all tokens at the heavy tier."""
    agg = chunks.groupBy("job_id").agg(
        F.count("*").alias("total_chunks"),
        *[F.count_if(F.col("tier") == t).alias(f"{t}_chunks") for t in TIERS],
        F.sum(F.col("map_tokens") * J_TYPICAL["heavy"]).alias("heavy_j"),
        F.sum(F.col("map_tokens") * rate(F.col("tier"))).alias("map_j"),
        F.max(intensity).alias("intensity"),
    )
    saved = kwh(facility(F.greatest(F.lit(0.0), F.col("heavy_j") - F.col("map_j"))))
    return agg.select("job_id", "total_chunks", *[f"{t}_chunks" for t in TIERS], saved.alias("kwh_saved"), (saved * F.col("intensity")).alias("co2e_g_saved"))


def uncertainty_bands(jobs: DataFrame, intensity: str = "intensity") -> DataFrame:
    """CAR10: baseline and optimised grams of a job at low, typical and high joules per token."""
    parts = []
    for name, table in BANDS.items():
        base = baseline_energy(jobs, table["heavy"], "b_")
        both = green_energy(base, table, "g_")
        parts.append(both.select("job_id", F.lit(name).alias("band"), (F.col("b_total_kwh") * F.col(intensity)).alias("baseline_g"), (F.col("g_total_kwh") * F.col(intensity)).alias("optimized_g")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def compile_tokens(jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """CAR11: explicit count, else the sum over compile nodes, else the roll-up, else a third of the input."""
    n = nodes.filter(~F.coalesce(F.col("kind"), F.lit("")).isin("chunk", "meta", "")).groupBy("job_id").agg(F.sum(count("tokens_in") + count("tokens_out")).alias("node_tokens"))
    pick = F.coalesce(
        F.when(F.col("explicit_tokens").isNotNull(), F.greatest(F.col("explicit_tokens"), F.lit(0))),
        F.when(F.col("node_tokens") > 0, F.col("node_tokens")),
        F.when((F.col("rollup_tokens") > 0) & (F.col("compile_calls") > 0), F.col("rollup_tokens")),
        F.floor(count("input_tokens") / 3),
    )
    return jobs.join(n, "job_id", "left").select("job_id", pick.cast("long").alias("compile_tokens"))


def workflow_carbon(jobs: DataFrame, intensity: str = "intensity") -> DataFrame:
    """CAR12: baseline, actual, saved (signed), efficiency and direction of a job."""
    df = green_energy(baseline_energy(jobs, prefix="b_"), prefix="g_")
    b, a = F.col("b_total_kwh") * F.col(intensity), F.col("g_total_kwh") * F.col(intensity)
    saved = b - a
    return df.select(
        "job_id", F.col("b_total_kwh").alias("baseline_kwh"), F.col("g_total_kwh").alias("actual_kwh"), b.alias("baseline_g"), a.alias("actual_g"), saved.alias("saved_g"),
        F.when(b > 0, saved / b * 100).otherwise(F.lit(0.0)).alias("efficiency_pct"),
        F.when(saved > 0, "saving").when(saved < 0, "overhead").otherwise("neutral").alias("direction"),
    )


def rag_query_carbon(q: DataFrame, intensity: str = "intensity") -> DataFrame:
    """CAR13: grams of a query by stage; the retrieval is free without hits and context."""
    tier = norm_tier("tier", "heavy")
    ctx = count("context_tokens")
    hits = count(F.coalesce(F.col("hits"), F.when(ctx > 0, F.greatest(F.lit(1), F.ceil(ctx / 350.0))).otherwise(F.lit(0))))
    j = {
        "query_embedding": count("query_tokens") * EMBEDDING_J,
        "retrieval": F.when((hits > 0) | (ctx > 0), RETRIEVAL_BASE_J + hits * RETRIEVAL_HIT_J).otherwise(F.lit(0.0)),
        "prompt": count("prompt_tokens") * rate(tier), "completion": count("output_tokens") * rate(tier),
    }
    g = {f"{k}_g": kwh(facility(v)) * F.col(intensity) for k, v in j.items()}
    total = sum(list(j.values())[1:], j["query_embedding"])
    return q.select("query_id", tier.alias("inference_tier"), *[v.alias(k) for k, v in g.items()], (kwh(facility(total)) * 1000).alias("energy_wh"), (kwh(facility(total)) * F.col(intensity)).alias("co2e_g"))


def frontier_compare(jobs: DataFrame, intensity: str = "intensity", badges: int = 3) -> DataFrame:
    """CAR14: each job at each frontier model, inference priced anew; badges to the lowest distinct rates.

    jobs: job_id, actual_g, tokens (map and compile), and the stage grams of its baseline.
    """
    spark = jobs.sparkSession
    models = spark.createDataFrame([(m, j) for m, j in FRONTIER.items()], "model string, j double")
    other = sum((F.col(f"{s}_gco2e") for s in STAGES[1:] if s != "inference"), F.col("parsing_gco2e"))
    new = kwh(F.col("tokens") * F.col("j")) * F.col(intensity)
    was, now = other + F.col("inference_gco2e"), other + new
    grams = now + F.when(was > 0, F.col("infrastructure_gco2e") * (now / was)).otherwise(F.col("infrastructure_gco2e"))
    df = jobs.crossJoin(F.broadcast(models)).withColumn("model_g", grams)
    cut = F.when(F.col("model_g") > 0, (1 - F.col("actual_g") / F.col("model_g")) * 100).otherwise(F.lit(0.0))
    w = Window.partitionBy("job_id").orderBy(F.desc("model_g"), "model")
    by_rate = Window.partitionBy("job_id").orderBy(F.desc("j"))
    df = df.withColumn("reduction_pct", cut).withColumn("place", F.row_number().over(w)).withColumn("rate_rank", F.dense_rank().over(by_rate))
    first = F.row_number().over(Window.partitionBy("job_id", "j").orderBy("model")) == 1
    return df.withColumn("badge", first & (F.col("rate_rank") <= badges)).select("job_id", "model", "model_g", "reduction_pct", F.col("place").cast("int"), "badge")


def node_accounting(nodes: DataFrame, intensity: str = "intensity") -> DataFrame:
    """CAR15: energy, grams and dollars of a node's tokens."""
    t = norm_tier("tier")
    tok = count("tokens_in") + count("tokens_out")
    j = facility(tok * rate(t))
    price = F.element_at(F.create_map(*[F.lit(x) for kv in COST_PER_1K.items() for x in kv]), t)
    return nodes.select("job_id", "node_id", t.alias("tier"), j.alias("energy_joules"), kwh(j).alias("energy_kwh"), (kwh(j) * F.col(intensity)).alias("carbon_g"), (tok / 1000.0 * price).alias("cost_usd"))


def pick_region(workloads: DataFrame, regions: DataFrame) -> DataFrame:
    """CAR16: the active region of least intensity for each workload; one candidate or none: the default."""
    ok = regions.filter("status = 'active' and supports_execution")
    best = ok.agg(F.count("*").alias("candidates"), F.min_by("region_id", F.struct("intensity", "region_id")).alias("best"), F.min("intensity").alias("best_intensity"))
    home = regions.filter("is_default").agg(F.min("region_id").alias("home"), F.min_by("intensity", "region_id").alias("home_intensity"))
    df = workloads.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(home))
    many = F.col("candidates") > 1
    return df.select("job_id", F.when(many, F.col("best")).otherwise(F.col("home")).alias("region_id"), F.when(many, F.col("best_intensity")).otherwise(F.col("home_intensity")).alias("intensity"), F.when(many, F.lit("carbon_optimized_selection")).otherwise(F.lit("configured_region")).alias("execution_status"))


def rank_servers(docs: DataFrame, servers: DataFrame) -> DataFrame:
    """CAR17: every document on every server, ranked by grams, with the best one's saving on the second."""
    energy = F.col("watts") * (F.col("tokens") / 1000.0) / 3_600_000.0
    df = docs.crossJoin(F.broadcast(servers)).withColumn("energy_kwh", energy).withColumn("carbon_g", energy * F.col("intensity")).withColumn("cost_usd", F.col("tokens") / 1000.0 * F.col("cost_per_1k"))
    w = Window.partitionBy("doc_id").orderBy("carbon_g", "server_id")
    saving = F.when(F.row_number().over(w) == 1, F.lead("carbon_g").over(w) - F.col("carbon_g"))
    return df.select("doc_id", "server_id", "energy_kwh", "carbon_g", "cost_usd", F.row_number().over(w).alias("place"), saving.alias("saved_g"))


def asof_intensity(events: DataFrame, readings: DataFrame, ttl_s: int = READING_TTL_S, fallback: float = FALLBACK_INTENSITY, bucket_s: int = 86_400) -> DataFrame:
    """CAR18: events (event_id, zone, ts) with the zone's latest reading at most ttl_s old, else fallback.

    A union sorted by time within (zone, bucket); a bucket also gets the readings of the ttl before it,
    so a busy zone spreads over its buckets.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    size = bucket_s * 1_000_000
    e = events.select("event_id", "zone", at("ts").alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind"))
    e = e.withColumn("bucket", F.floor(F.col("t") / size))
    r = readings.filter("intensity is not null").select(F.lit(None).cast("long").alias("event_id"), "zone", at("ts").alias("t"), F.col("intensity").cast("double").alias("v"), F.lit(0).alias("kind"))
    r = r.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(F.col("t") / size), F.floor((F.col("t") + ttl_s * 1_000_000) / size)))))
    w = Window.partitionBy("zone", "bucket").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("v").isNotNull(), F.struct("t", "v")), ignorenulls=True).over(w)
    df = e.unionByName(r).withColumn("last", last).filter("kind = 1")
    fresh = F.col("t") - F.col("last.t") <= ttl_s * 1_000_000
    return df.select("event_id", F.when(fresh, F.col("last.v")).otherwise(F.lit(fallback)).alias("intensity"), F.coalesce(fresh, F.lit(False)).alias("fresh"))


def moer_to_g(pounds_per_mwh: Column) -> Column:
    """CAR19: pounds a MWh to grams a kWh."""
    return pounds_per_mwh * 453.592 / 1000.0


def index_to_g(index: Column) -> Column:
    return 200.0 + 500.0 * (index / 100.0)


def api_prices(model: Column) -> tuple[Column, Column]:
    m = F.lower(model)
    known = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in API_PRICES.items() for x in (k, v[i])]), model)
    family = (
        F.when(F.contains(m, F.lit("8b")) | (F.contains(m, F.lit("nemotron")) & ~F.contains(m, F.lit("embed"))), 0.06)
        .when(F.contains(m, F.lit("14b")) | F.contains(m, F.lit("ministral")), 0.20)
        .when(F.contains(m, F.lit("70b")) | F.contains(m, F.lit("120b")), 0.90)
        .otherwise(0.0)
    )
    return F.coalesce(known(0), family), F.coalesce(known(1), family)


def api_cost(model: Column, prompt: Column, completion: Column) -> Column:
    """CAR20: dollars at list prices a million tokens, by family where a model is not listed."""
    i, o = api_prices(model)
    return count(prompt) / 1_000_000.0 * i + count(completion) / 1_000_000.0 * o


def energy_tier(model: Column) -> Column:
    m = F.lower(model)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ENERGY_TIERS.items() for x in kv]), model)
    family = F.when(F.contains(m, F.lit("8b")), "light").when(F.contains(m, F.lit("14b")) | F.contains(m, F.lit("ministral")), "medium").when(F.contains(m, F.lit("70b")) | F.contains(m, F.lit("120b")), "heavy")
    return F.coalesce(known, family, F.lit("medium"))
