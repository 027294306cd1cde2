"""Capability scores, model ranking and routing of chunks to tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import clamp, norm_preference
from .running import composed, ema_map, moving_mean, numbered

TIERS = ("light", "medium", "heavy")
# Floors by domain, cuts of the score, weights, chunks that make a compile heavy.
DOMAIN_FLOORS = {"medical": (0.70, 2), "legal": (0.55, 1), "financial": (0.45, 1), "regulatory": (0.45, 1)}
RISK_FLOORS = {"high": (0.45, 1), "medium": (0.35, 1)}
CUTS, WEIGHTS, HEAVY_COMPILE_CHUNKS = (0.35, 0.65), (0.35, 0.20, 0.20, 0.25), 40
# Weights of a preference (capacity, accuracy, retrieval, latency, cost, CO2, availability) and tier profiles.
BALANCED, ECO = (0.30, 0.25, 0.10, 0.10, 0.10, 0.05, 0.10), (0.28, 0.22, 0.10, 0.05, 0.10, 0.20, 0.05)
HIGH_QUALITY, FAST, CHEAP = (0.32, 0.28, 0.10, 0.15, 0.05, 0.00, 0.10), (0.28, 0.20, 0.10, 0.25, 0.05, 0.02, 0.10), (0.28, 0.22, 0.10, 0.08, 0.22, 0.05, 0.05)
MODES = {"automatic": BALANCED, "fastest": FAST, "lowest_cost": CHEAP, "lowest_carbon": ECO, "highest_quality": HIGH_QUALITY, "eco": ECO, "balanced": BALANCED, "performance": HIGH_QUALITY, "quality": HIGH_QUALITY}
PROFILES = {"light": (0.30, 0.55, 0.20, 0.15, 0.15), "medium": (0.65, 0.78, 0.45, 0.45, 0.45), "heavy": (0.95, 0.92, 0.80, 0.85, 0.85)}
# Quality, grams and milliseconds expected of a chunk by tier.
EXPECTED = {"light": (0.88, 0.08, 800.0), "medium": (0.95, 0.18, 1600.0), "heavy": (0.97, 0.41, 3200.0)}


def rank(tier: Column) -> Column:
    t = F.lower(tier)
    return F.when(t == "light", 0).when(t.isin("heavy", "large"), 2).otherwise(1)


def tier_of(r: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), (r + 1).cast("int"))


def look(table: dict, key: Column, i: int, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])]), key), F.lit(default))


def domain_floor(domain: Column, risk: Column) -> tuple[Column, Column]:
    """CRE1: least score and least tier rank of a domain, else of its risk."""
    d, r = F.lower(F.coalesce(domain, F.lit("general"))), F.lower(F.coalesce(risk, F.lit("general")))
    known = d.isin(*DOMAIN_FLOORS)
    return F.when(known, look(DOMAIN_FLOORS, d, 0, 0.0)).otherwise(look(RISK_FLOORS, r, 0, 0.0)), F.when(known, look(DOMAIN_FLOORS, d, 1, 0)).otherwise(look(RISK_FLOORS, r, 1, 0))


def compute_crs(df: DataFrame) -> DataFrame:
    """CRE2: (doc_id, reasoning, structural, coherence, retrieval, domain, risk, chunk_count) -> scores and tiers."""
    part = lambda c, d: clamp(F.coalesce(c, F.lit(d)))
    x = part("coherence", 0.3)
    raw = clamp(WEIGHTS[0] * part("reasoning", 0.4) + WEIGHTS[1] * part("structural", 0.3) + WEIGHTS[2] * x + WEIGHTS[3] * (1.0 - part("retrieval", 0.7)))
    floor, least = domain_floor(F.col("domain"), F.col("risk"))
    df = df.withColumn("crs_raw", raw).withColumn("crs_floor", floor).withColumn("crs", F.greatest("crs_raw", "crs_floor"))
    own = F.when(F.col("crs") < CUTS[0], 0).when(F.col("crs") < CUTS[1], 1).otherwise(2)
    df = df.withColumn("min_rank", F.greatest(own, least))
    n = F.coalesce("chunk_count", F.lit(0))
    compiled = F.when((x >= 0.55) | (n >= HEAVY_COMPILE_CHUNKS), F.greatest("min_rank", F.lit(2))).when((x >= 0.40) | (n >= 12), F.greatest("min_rank", F.lit(1))).otherwise(F.col("min_rank"))
    return df.select("doc_id", "crs_raw", "crs_floor", "crs", tier_of(F.col("min_rank")).alias("min_tier"), tier_of(compiled).alias("compile_tier"))


def rank_models(docs: DataFrame, catalog: DataFrame, top: int = 8) -> DataFrame:
    """RTE1: (doc_id, crs, min_tier, retrieval, intensity, mode) x (model, tier, is_primary, availability) -> the best models.

    Models under the least tier are out; a document without any gets none (the caller fails closed to
    heavy). The catalogue is small and broadcast.
    """
    df = docs.crossJoin(F.broadcast(catalog)).filter(rank(F.col("tier")) >= rank(F.col("min_tier")))
    mode = norm_preference("mode")
    w = [look(MODES, mode, i, BALANCED[i]) for i in range(7)]
    p = [look(PROFILES, F.col("tier"), i, PROFILES["medium"][i]) for i in range(5)]
    fit = F.when(p[0] + 1e-6 < F.col("crs"), F.greatest(F.lit(0.0), 1.0 - (F.col("crs") - p[0]) * 2)).otherwise(F.lit(1.0))
    co2 = p[4] * (0.5 + 0.5 * clamp((F.col("intensity") - 200) / 600))
    u = w[0] * fit + w[1] * p[1] + w[2] * F.col("retrieval") - w[3] * p[2] - w[4] * p[3] - w[5] * co2 + w[6] * F.col("availability") + F.when(F.col("is_primary"), 0.02).otherwise(0.0)
    by = Window.partitionBy("doc_id").orderBy(F.desc(F.round("utility", 9)), "model")
    return df.withColumn("utility", u).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= top).select("doc_id", "model", "tier", "utility", "place")


def suggest_tier(f: DataFrame) -> DataFrame:
    """RTE2: tier and reasons of a chunk from its features."""
    c = F.col
    hard = c("section_type").isin("legal", "equation_heavy")
    score = 0.35 * c("complexity") + 0.30 * c("importance") + 0.20 * c("technical_density") + 0.10 * F.least(F.lit(1.0), c("equation_count") / 4.0) + 0.05 * F.least(F.lit(1.0), c("token_count") / 1500.0) + F.when(hard, 0.12).otherwise(0.0)
    f = f.withColumn("route_score", score)
    heavy = (c("route_score") >= 0.72) | ((c("complexity") >= 0.82) & (c("importance") >= 0.75))
    medium = (c("route_score") >= 0.42) | c("section_type").isin("technical", "table")
    tier = F.when(heavy, "heavy").when(medium, "medium").otherwise("light")
    why = F.array_compact(F.array(F.when(hard, F.concat(F.lit("section_type="), "section_type")), F.when(c("equation_count") > 0, F.lit("equations")), F.when(c("importance") >= 0.85, F.lit("high importance")), F.when(c("complexity") >= 0.75, F.lit("high complexity"))))
    return f.withColumn("suggested", tier).withColumn("reasons", why)


def route_chunks(f: DataFrame, min_tier: str = "light", gain_min: float = 0.02, prefer_light: bool = False, intensity: float = 700.0, budget_g: float | None = None) -> DataFrame:
    """RTE3: final tier of each chunk: floor, negligible-gain and grid rules as columns; the carbon budget as an
    ordered fold over a document's chunks, since what is left depends on what was chosen before."""
    floor = rank(F.lit(min_tier))
    s = suggest_tier(f)
    r = F.greatest(rank(F.col("suggested")), floor)
    if EXPECTED["heavy"][0] - EXPECTED["medium"][0] < gain_min and min_tier != "heavy":
        r = F.when(r == 2, 1).otherwise(r)
    if prefer_light and intensity >= 500 and min_tier != "heavy":
        r = F.when(r == 2, 1).otherwise(r)
    if prefer_light and intensity >= 650 and min_tier == "light":
        r = F.when((r == 1) & (F.col("complexity") < 0.55), 0).otherwise(r)
    s = s.withColumn("r", r)
    if budget_g is not None:
        low = TIERS.index(min_tier)
        grams = lambda x: F.element_at(F.array(*[F.lit(EXPECTED[t][1]) for t in TIERS]), (x + 1).cast("int"))

        def step(acc, x):
            over = (acc["spent"] + grams(x["r"]) > budget_g) & (x["r"] > 0) & (x["r"] - 1 >= low)
            r = F.when(over, x["r"] - 1).otherwise(x["r"])
            return F.struct((acc["spent"] + grams(r)).alias("spent"), F.concat(acc["out"], F.array(F.struct(x["chunk_index"].alias("chunk_index"), r.alias("r")))).alias("out"))

        g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "r"))).alias("xs"))
        start = F.struct(F.lit(0.0).alias("spent"), F.array().cast(g.schema["xs"].dataType).alias("out"))
        done = g.select("doc_id", F.explode(F.aggregate("xs", start, step)["out"]).alias("x")).select("doc_id", "x.chunk_index", F.col("x.r").alias("final"))
        s = s.join(done, ["doc_id", "chunk_index"]).withColumn("r", F.col("final")).drop("final")
    t = tier_of(F.col("r"))
    return s.withColumn("tier", t).withColumns({n: look(EXPECTED, F.col("tier"), i, 0.0) for i, n in enumerate(("expected_quality", "expected_carbon_g", "expected_latency_ms"))}).drop("r")


def routing_distribution(routes: DataFrame) -> DataFrame:
    """RTE4: chunks and shares of a document by tier, with predicted grams."""
    n = F.greatest(F.lit(1), F.count("*"))
    return routes.groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS], *[(100.0 * F.count_if(F.col("tier") == t) / n).alias(f"{t}_pct") for t in TIERS], F.sum("expected_carbon_g").alias("predicted_g"))


def dynamic_fan_in(df: DataFrame, window: int = 12_000, budget: int = 9_600) -> DataFrame:
    """RTE6: (doc_id, doc_tokens, chunk_count) -> fan-in and depth of the compile tree."""
    n = F.greatest(F.lit(1), F.col("chunk_count"))
    mean = F.greatest(F.lit(50), F.floor(F.greatest(F.lit(1), F.col("doc_tokens")) / n))
    fan = F.greatest(F.lit(2), F.least(F.lit(24), F.floor(max(400, int(budget * 0.85)) / F.greatest(F.lit(80), F.floor(mean / 4)))))
    depth = F.when(n <= 8, 2).otherwise(F.greatest(F.lit(3), F.least(F.lit(16), F.ceil(F.round(F.log(F.greatest(F.lit(2), n)) / F.log(F.greatest(F.lit(2), fan)), 12)) + 2)))
    return df.select("doc_id", (F.least(F.lit(24), fan + 2) if window >= 16_000 else fan).cast("int").alias("fan_in"), depth.cast("int").alias("max_depth"))


def escalate_tier(tier: Column) -> Column:
    """RTE7: the next tier up; heavy stays."""
    return tier_of(F.least(rank(tier) + 1, F.lit(2)))


def rolling_latency(calls: DataFrame, last: int = 32) -> DataFrame:
    """RTE9: mean latency of a model's last 32 calls at each call."""
    return moving_mean(calls, ["model"], [F.col("seq")], "latency_ms", last, "rolling_ms").select("model", "seq", "rolling_ms")


def routing_expectations(routes: DataFrame) -> DataFrame:
    """RTE11: expected quality, grams and latency of a document's mix."""
    return routes.groupBy("doc_id").agg(F.avg("expected_quality").alias("quality"), F.sum("expected_carbon_g").alias("carbon_g"), F.avg("expected_latency_ms").alias("latency_ms"))


def compare_strategies(routes: DataFrame) -> DataFrame:
    """RTE10: the same chunks all heavy, all medium, or as routed: quality, grams, share heavy."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), t.alias("t")) for n, t in (("always_heavy", F.lit("heavy")), ("always_medium", F.lit("medium")), ("adaptive", F.col("tier")))]))
    x = routes.select("doc_id", named.alias("x")).select("doc_id", "x.strategy", "x.t")
    return x.groupBy("doc_id", "strategy").agg(F.avg(look(EXPECTED, F.col("t"), 0, 0.0)).alias("quality"), F.sum(look(EXPECTED, F.col("t"), 1, 0.0)).alias("carbon_g"), F.avg((F.col("t") == "heavy").cast("int")).alias("heavy_share"))


# Start and step of the averages, seconds that a failure and a rate limit cool an endpoint.
ENDPOINT_START = {"latency": 1500.0, "ttft": 800.0, "tps": 20.0}
ENDPOINT_ALPHA, COOL_FAILED_S, COOL_LIMITED_S = 0.2, 8.0, 20.0


def rank_endpoints(calls: DataFrame, now_s: float, max_concurrent: int = 6) -> DataFrame:
    """RTE12: endpoints by (open calls, latency average, health score), the best first.

    calls: (endpoint, call_id, started_s, ended_s, ok, latency_ms, ttft_ms, tokens, rate_limited), ended_s null or after now_s while open.
    Averages take the closed calls in order of their end: latency and time to first token if over 0, tokens a
    second if there are any. The score is lower for better ones: 0.45 load, 0.25 first token, 0.15 speed, 0.15 failures;
    endpoints that cool down score 1e9. A call that fails cools for 8 s, a rate limit for 20 s.
    """
    open_ = F.col("ended_s").isNull() | (F.col("ended_s") > now_s)
    started = calls.filter(F.col("started_s") <= now_s)
    closed = numbered(started.filter(~open_), ["endpoint"], [F.col("ended_s"), F.col("call_id")])
    tps = F.col("tokens") / F.greatest(F.lit(0.05), F.col("latency_ms") / 1000.0)
    steps = composed(closed, ["endpoint"], {
        "latency": ema_map(F.col("latency_ms"), F.col("latency_ms") > 0, ENDPOINT_ALPHA),
        "ttft": ema_map(F.col("ttft_ms"), F.col("ttft_ms") > 0, ENDPOINT_ALPHA),
        "tps": ema_map(tps, (F.col("tokens") > 0) & (F.col("latency_ms") > 0), ENDPOINT_ALPHA),
    })
    cool = F.greatest(F.when(~F.col("ok"), F.col("ended_s") + COOL_FAILED_S), F.when(F.col("rate_limited"), F.col("ended_s") + COOL_LIMITED_S))
    totals = started.groupBy("endpoint").agg(
        F.count_if(open_).alias("active"), F.count_if(~open_).alias("calls"),
        F.count_if(~open_ & F.col("ok")).alias("successes"), F.max(F.when(~open_, cool)).alias("cool_until"),
    )
    g = totals.join(steps, "endpoint", "left")
    for name, first in ENDPOINT_START.items():
        g = g.withColumn(name, F.coalesce(F.col(f"{name}_a") * first + F.col(f"{name}_b"), F.lit(first)))
    failed = F.when(F.col("calls") > 0, 1 - F.col("successes") / F.col("calls")).otherwise(0.0)
    score = (
        0.45 * F.least(F.lit(1.0), F.col("active") / float(max(1, max_concurrent))) + 0.25 * F.least(F.lit(1.0), F.col("ttft") / 8000.0)
        + 0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("tps") / 40.0)) + 0.15 * failed
    )
    g = g.withColumn("health", F.when(F.coalesce(F.col("cool_until") > now_s, F.lit(False)), 1e9).otherwise(score))
    g = g.select("endpoint", "active", "calls", F.round("latency", 6).alias("latency_ms"), F.round("ttft", 6).alias("ttft_ms"), F.round("tps", 6).alias("tps"), F.round("health", 9).alias("health"))
    return numbered(g, [], [F.col("active"), F.col("latency_ms"), F.col("health"), F.col("endpoint")], "place").withColumn("place", F.col("place") + 1)


def model_chain(decisions: DataFrame, heavy: list[str]) -> DataFrame:
    """RTE13: compile fallbacks, else the selected model and its fallbacks, then the heavy list; first occurrences."""
    own = F.when(F.size("compile_fallbacks") > 0, F.col("compile_fallbacks")).otherwise(F.concat(F.array("selected_model"), "fallbacks"))
    return decisions.select("doc_id", F.array_distinct(F.concat(own, F.array(*[F.lit(m) for m in heavy]))).alias("chain"))

# Quality, milliseconds and grams a node expects of a tier; weights of the utility.
NODE_PRIORS = {"light": (0.62, 800.0, 0.08), "medium": (0.78, 1800.0, 0.22), "heavy": (0.92, 4500.0, 0.55)}
NODE_WEIGHTS = (0.30, 0.30, 0.25, 0.25)


def assign_models(nodes: DataFrame, chain: DataFrame, latency: DataFrame) -> DataFrame:
    """RTE8: (job_id, node_id, kind, min_tier, load, intensity, prefer_quality) x (place, model) -> the model of best utility.

    Earlier models of the chain are cheaper: their place decides which priors they get, live latency
    replaces the prior's, and a busy pool or a dirty grid favours them. Where quality is preferred it weighs more, the last
    model has the heavy tier's priors, and a calm pool and grid favour later models.
    """
    size = chain.agg(F.count("*").alias("n"))
    df = nodes.crossJoin(F.broadcast(chain.crossJoin(size))).join(F.broadcast(latency), "model", "left")
    frac = F.when(F.col("n") > 1, F.col("place") / (F.col("n") - 1)).otherwise(0.0)
    prefer = F.coalesce("prefer_quality", F.lit(False))
    tier = (
        F.when((F.col("min_tier") == "heavy") | (prefer & (F.col("place") == F.col("n") - 1)), F.lit("heavy"))
        .when(F.col("min_tier") == "light", F.when(F.col("place") == 0, "light").otherwise("medium"))
        .otherwise(F.when((F.col("place") > 0) & (frac > 0.66), "heavy").otherwise("medium"))
    )
    p = [look(NODE_PRIORS, tier, i, NODE_PRIORS["medium"][i]) for i in range(3)]
    dirty = clamp((F.col("intensity") - 200.0) / 600.0)
    quality = F.when(prefer | F.col("kind").isin("executive", "final"), 0.40).otherwise(NODE_WEIGHTS[0])
    u = quality * p[0] - NODE_WEIGHTS[1] * F.coalesce("rolling_ms", p[1]) / 5000.0 - NODE_WEIGHTS[2] * dirty * p[2] / 0.55 - NODE_WEIGHTS[3] * F.col("load") * frac
    u = u + F.when((F.col("load") > 0.55) | (dirty > 0.55), 0.08 * (1.0 - frac)).otherwise(0.0)
    u = u + F.when(prefer & (F.col("load") < 0.35) & (dirty < 0.45), 0.06 * frac).otherwise(0.0)
    df = df.withColumn("utility", u)
    return df.groupBy("job_id", "node_id").agg(F.max(F.struct(F.round("utility", 9).alias("u"), (-F.col("place")).alias("k"), "model")).alias("b")).select("job_id", "node_id", F.col("b.model").alias("model"), F.col("b.u").alias("utility"))

# Strategy of each scale: id, map mode, compile hint, verification, thresholds, escalations, chunks, budget factor, gain.
STRATEGIES = {
    "tiny": ("single_pass_compact", "single_pass", "medium", "light", 0.55, 1, 4, 1.0, 0.03), "small": ("map_reduce_standard", "map_reduce", "medium", "standard", 0.58, 2, 6, 1.0, 0.02),
    "medium": ("hierarchical_map_regional", "hierarchical_map", "medium", "standard", 0.60, 2, 8, 1.0, 0.02), "large": ("multi_level_tree", "tree_summarize", "heavy", "strict", 0.62, 2, 10, 1.25, 0.015),
    "xlarge": ("deep_tree_summarize", "tree_summarize", "heavy", "strict", 0.64, 3, 12, 1.5, 0.01),
}
STRATEGY_COLUMNS = "strategy_id map_mode compile_tier verification confidence_at max_escalations escalated_chunks budget_factor gain_min".split()


def select_strategy(profiles: DataFrame, mode: str = "automatic", intensity: float = 700.0) -> DataFrame:
    """RTE5: (doc_id, document_scale, complexity_class) -> strategy: the scale's row, adjusted by complexity, mode and grid."""
    base = profiles.select("doc_id", "document_scale", "complexity_class", *[look(STRATEGIES, F.col("document_scale"), i, STRATEGIES["xlarge"][i]).alias(c) for i, c in enumerate(STRATEGY_COLUMNS)])
    hard, simple = F.col("complexity_class").isin("complex", "critical"), (F.col("complexity_class") == "simple") & F.col("document_scale").isin("tiny", "small")
    df = base.withColumns({
        "verification": F.when(hard, "strict").when(simple, "light").otherwise(F.col("verification")), "confidence_at": F.when(hard, F.least(F.lit(0.72), F.col("confidence_at") + 0.04)).otherwise(F.col("confidence_at")),
        "compile_tier": F.when(F.col("complexity_class") == "critical", "heavy").otherwise(F.col("compile_tier")), "escalated_chunks": F.when(hard, F.least(F.lit(16), F.col("escalated_chunks") + 2)).otherwise(F.col("escalated_chunks")), "prefer_light": F.lit(True),
    })
    if mode in ("fastest", "speed"):
        df = df.withColumns({"max_escalations": F.greatest(F.lit(1), F.col("max_escalations") - 1), "compile_tier": F.lit("medium")})
    elif mode in ("lowest_carbon", "eco", "green"):
        df = df.withColumns({"budget_factor": F.col("budget_factor") * 0.75, "gain_min": F.greatest("gain_min", F.lit(0.04))})
    elif mode in ("highest_quality", "quality"):
        df = df.withColumns({"verification": F.lit("strict"), "compile_tier": F.lit("heavy"), "max_escalations": F.least(F.lit(3), F.col("max_escalations") + 1), "prefer_light": F.lit(intensity >= 550)})
    return df
