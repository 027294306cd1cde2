"""Evaluation of model runs: aggregates, lexical scores, highlights, campaigns, trade-offs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.text import clamp, strip, text_of, token_set, tokens

ROUTER = "intelligent-router"
# Metrics of the highlights and whether the least or the most is best.
HIGHLIGHTS = {
    "fastest_model": ("avg_latency_ms", "min"), "highest_tokens_per_sec": ("avg_tokens_per_sec", "max"),
    "lowest_estimated_cost": ("total_cost_usd", "min"), "lowest_estimated_co2e": ("avg_co2e_g", "min"), "best_quality_model": ("avg_quality_score", "max"),
}


def per_model(runs: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """EVL1: runs (model, ok, dry_run, skipped, latency_ms, tokens_per_sec, prompt_tokens, completion_tokens,
    cost_usd, cost_upper_usd, energy_wh, co2e_g, quality_score) -> one row a model.

    Only runs that are ok count in figures; a dry run's cost is its upper bound, and it has no quality.
    """
    ok = F.col("ok")
    cost = F.when(F.col("dry_run"), F.coalesce("cost_upper_usd", "cost_usd")).otherwise(F.col("cost_usd"))
    quality = F.when(ok & ~F.col("dry_run") & ~F.col("skipped"), F.col("quality_score"))
    v = lambda c: F.when(ok, c if isinstance(c, Column) else F.col(c))
    p = lambda c, q: F.percentile(c, F.lit(q))
    total = lambda c: F.coalesce(F.sum(v(c)), F.lit(0.0))
    return runs.groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"),
        F.avg(v("latency_ms")).alias("avg_latency_ms"), p(v("latency_ms"), 0.5).alias("p50_latency_ms"), p(v("latency_ms"), 0.95).alias("p95_latency_ms"),
        F.avg(v("tokens_per_sec")).alias("avg_tokens_per_sec"), F.avg(v("prompt_tokens")).alias("avg_prompt_tokens"), F.avg(v("completion_tokens")).alias("avg_completion_tokens"),
        F.avg(v(cost)).alias("avg_cost_usd"), total(cost).alias("total_cost_usd"), total("energy_wh").alias("total_energy_wh"),
        F.avg(v("co2e_g")).alias("avg_co2e_g"), total("co2e_g").alias("total_co2e_g"),
        F.avg(quality).alias("avg_quality_score"), p(quality, 0.5).alias("median_quality_score"), F.count(quality).alias("n_quality_scored"),
    )


def quality_summary(runs: DataFrame) -> DataFrame:
    """EVL2: the distribution of all quality scores and the model of the best mean; one row."""
    q = runs.filter("ok and not dry_run and not skipped and quality_score is not null")
    p = F.percentile("quality_score", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    d = q.agg(F.count("*").alias("n_scored"), F.avg("quality_score").alias("mean"), F.min("quality_score").alias("min"), p.alias("p"), F.max("quality_score").alias("max"))
    best = q.groupBy("model").agg(F.avg("quality_score").alias("m")).agg(F.min(F.struct((-F.col("m")).alias("k"), "model"))["model"].alias("best_model"))
    return d.crossJoin(best).select("n_scored", "mean", "min", F.col("p")[0].alias("p25"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p75"), "max", "best_model")


def quality_scatter(runs: DataFrame) -> DataFrame:
    """EVL2: a point for each scored run: quality beside latency, cost, CO2e and speed."""
    q = runs.filter("ok and not dry_run and not skipped and quality_score is not null")
    return q.select("run_id", "model", "quality_score", "latency_ms", "cost_usd", "co2e_g", "tokens_per_sec")


def normal(c) -> Column:
    return F.regexp_replace(strip(F.lower(text_of(c))), r"\s+", " ")


def exact_match(ref, cand) -> Column:
    return F.when(normal(ref) == normal(cand), F.lit(100.0)).otherwise(F.lit(0.0))


def token_recall(ref, cand) -> Column:
    return _recall(token_set(ref, "eval"), token_set(cand, "eval"))


def _recall(r: Column, c: Column) -> Column:
    return F.when(F.size(r) == 0, F.when(F.size(c) == 0, 100.0).otherwise(50.0)).when(F.size(c) == 0, 0.0).otherwise(100.0 * F.size(F.array_intersect(r, c)) / F.size(r))


def token_f1(ref, cand) -> Column:
    return _f1(token_set(ref, "eval"), token_set(cand, "eval"))


def _f1(r: Column, c: Column) -> Column:
    # p and q are shares of `both`, so 2pq / (p + q) is twice `both` over the two sizes.
    f1 = 200.0 * F.size(F.array_intersect(r, c)) / (F.size(r) + F.size(c))
    return F.when((F.size(r) == 0) & (F.size(c) == 0), 100.0).when((F.size(r) == 0) | (F.size(c) == 0), 0.0).otherwise(f1)


def length_ratio(ref, cand) -> Column:
    n = lambda x: _count(tokens(x, "eval"), normal(x))
    return _ratio(n(ref), n(cand))


def _count(words: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(F.size(words), F.lit(0)), F.length(text))


def _ratio(r: Column, c: Column) -> Column:
    ratio = c / r
    return (
        F.when((r <= 0) & (c <= 0), 100.0).when(c <= 0, 0.0)
        .when(r <= 0, clamp(100.0 - F.least(F.lit(80.0), c * 2.0), 0.0, 100.0))
        .when(ratio.between(0.6, 1.4), 100.0).when(ratio < 0.6, 100.0 * (ratio / 0.6)).otherwise(100.0 * (1.4 / ratio))
    )


_SIDES = ("ref__", "cand__")


def _with_sides(pairs: DataFrame, ref: str, cand: str) -> DataFrame:
    """Tokens, token set, normal form and length of both sides as columns: each is made once a row, however often read."""
    df = pairs
    for side, c in zip(_SIDES, (ref, cand)):
        df = df.withColumns({f"{side}t": tokens(c, "eval"), f"{side}n": normal(c)})
        df = df.withColumns({f"{side}s": F.array_distinct(f"{side}t"), f"{side}l": _count(F.col(f"{side}t"), F.col(f"{side}n"))})
    return df


def _without_sides(df: DataFrame) -> DataFrame:
    return df.drop(*[f"{side}{x}" for side in _SIDES for x in "tnsl"])


def lexical_scores(pairs: DataFrame, ref: str = "reference", cand: str = "candidate") -> DataFrame:
    """EVL3: exact match, token recall, length ratio and token F1 of each pair, 0 to 100."""
    r, c = (lambda x: F.col(f"ref__{x}")), (lambda x: F.col(f"cand__{x}"))
    return _without_sides(_with_sides(pairs, ref, cand).withColumns({
        "exact_match": F.when(r("n") == c("n"), 100.0).otherwise(0.0), "token_recall": _recall(r("s"), c("s")), "length_ratio": _ratio(r("l"), c("l")), "token_f1": _f1(r("s"), c("s")),
    }))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() * 100.0 for x, y in zip(a, b)])


def sequence_similarity(ref, cand) -> Column:
    """EVL4: 0.45 of the matching-blocks ratio and 0.55 of the token F1; the ratio runs over Arrow batches."""
    return _similarity(normal(ref), normal(cand), token_f1(ref, cand))


def _similarity(r: Column, c: Column, f1: Column) -> Column:
    mixed = 0.45 * sequence_ratio(r, c) + 0.55 * f1
    return F.when((r == "") & (c == ""), 100.0).when((r == "") | (c == ""), 0.0).otherwise(mixed)


def grounding(cand, context) -> Column:
    """EVL5: overlap of candidate tokens with the context, bonuses for citing and for shared three-word phrases; null without context."""
    c, x = token_set(cand, "eval"), token_set(context, "eval")
    low, ctx, w = F.lower(text_of(cand)), normal(context), tokens(cand, "eval")
    # Marks of a citation.
    cites = F.array_contains(F.transform(F.array(*[F.lit(m) for m in ("[", "source", "according to", "as stated", "cited")]), lambda m: F.contains(low, m)), F.lit(True))

    def phrases(l):
        n = F.greatest(F.size(l) - 2, F.lit(0))
        join = lambda a, b: F.concat_ws(" ", a, b)
        return F.zip_with(F.zip_with(F.slice(l, F.lit(1), n), F.slice(l, F.lit(2), n), join), F.slice(l, F.lit(3), n), join)

    # Tokens and context are bound once, as elements of arrays; in a lambda they would be made anew for every phrase.
    both = F.array(F.struct(w.alias("w"), ctx.alias("ctx")))
    hits = F.get(F.transform(both, lambda b: F.size(F.filter(phrases(b["w"]), lambda g: F.contains(b["ctx"], g)))), F.lit(0))
    score = 100.0 * F.least(F.lit(1.0), F.size(F.array_intersect(c, x)) / F.greatest(F.lit(1), F.size(c)) + F.when(cites, 0.08).otherwise(0.0) + F.least(F.lit(0.15), hits * 0.03))
    return F.when(strip(text_of(context)) == "", F.lit(None)).when((F.size(c) == 0) | (F.size(x) == 0), 0.0).otherwise(score)


def composite(pairs: DataFrame) -> DataFrame:
    """EVL6: (pair_id, reference, candidate, context) -> quality and its parts; skipped without a reference."""
    ref, cand = "reference", "candidate"
    skipped, empty = strip(text_of(ref)) == "", strip(text_of(cand)) == ""
    df = lexical_scores(pairs, ref, cand).withColumnsRenamed({"exact_match": "em", "token_recall": "completeness", "length_ratio": "conciseness"})
    df = df.withColumns({"lex": _similarity(normal(ref), normal(cand), F.col("token_f1")), "groundedness": grounding(cand, "context")})
    df = df.withColumn("correctness", 0.35 * F.col("em") + 0.65 * F.col("lex"))
    with_ctx = F.col("correctness") * 0.40 + F.col("completeness") * 0.25 + F.col("conciseness") * 0.15 + F.col("groundedness") * 0.20
    without = F.col("correctness") * 0.45 + F.col("completeness") * 0.30 + F.col("conciseness") * 0.25
    q = F.coalesce(with_ctx, without)
    note = F.when(skipped, "skipped").when(empty, "empty").when(F.col("em") >= 100, "exact").when(F.col("lex") >= 80, "high").when(F.col("lex") < 40, "low").otherwise("plain")
    return df.select("pair_id", skipped.alias("skipped"), F.when(~skipped, F.when(empty, 0.0).otherwise(clamp(q, 0.0, 100.0))).alias("quality_score"), "correctness", "completeness", "groundedness", "conciseness", note.alias("note"))


def highlights(models: DataFrame) -> DataFrame:
    """EVL7: (highlight, model, value): the best model of each metric, ties to the first name."""
    def best(metric: str, way: str):
        v = F.col(metric) if way == "min" else -F.col(metric)
        return F.min(F.when(F.col(metric).isNotNull(), F.struct(v.alias("k"), "model", F.col(metric).cast("double").alias("value"))))

    one = models.agg(*[best(*mw).alias(name) for name, mw in HIGHLIGHTS.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("highlight"), F.col(f"{name}.model").alias("model"), F.col(f"{name}.value").alias("value")) for name in HIGHLIGHTS])
    return one.select(F.inline(rows))


def quality_insights(models: DataFrame, router: str = ROUTER) -> DataFrame:
    """EVL8: the router beside the model of best quality: share of quality, cost, latency and CO2e changes."""
    best = models.filter("avg_quality_score is not null").agg(F.min(F.struct((-F.col("avg_quality_score")).alias("k"), "model", "avg_quality_score", "total_cost_usd", "avg_latency_ms", "avg_co2e_g")).alias("b"))
    r = models.filter(F.col("model") == router)
    less = lambda c: F.when(F.col(f"b.{c}") > 0, (1 - F.col(c) / F.col(f"b.{c}")) * 100)
    return r.crossJoin(F.broadcast(best)).select(F.col("b.model").alias("best_model"), F.when(F.col("b.avg_quality_score") > 0, F.col("avg_quality_score") / F.col("b.avg_quality_score") * 100).alias("quality_pct"), less("total_cost_usd").alias("cost_less_pct"), less("avg_latency_ms").alias("latency_less_pct"), less("avg_co2e_g").alias("co2e_less_pct"))


def dashboard_series(models: DataFrame) -> DataFrame:
    """EVL9: aggregates as (chart, model, metric, value) rows."""
    # Charts and their metrics.
    charts = {
        "latency": ("avg_latency_ms", "p50_latency_ms", "p95_latency_ms"), "tokens": ("avg_prompt_tokens", "avg_completion_tokens"),
        "cost": ("avg_cost_usd", "total_cost_usd"), "co2e": ("avg_co2e_g", "total_co2e_g"), "quality": ("avg_quality_score", "median_quality_score"),
    }
    chart_of = F.create_map(*[F.lit(x) for c, ms in charts.items() for m in ms for x in (m, c)])
    names = [m for ms in charts.values() for m in ms]
    long = models.select("model", *[F.col(m).cast("double").alias(m) for m in names]).unpivot(["model"], names, "metric", "value")
    return long.select(F.element_at(chart_of, F.col("metric")).alias("chart"), "model", "metric", "value")


def freeze(inputs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """EVL10: a hash of each row's frozen inputs."""
    return inputs.select(key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("input_hash"))


def verify_frozen(frozen: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """EVL10: keys whose inputs changed, came or went."""
    n = now.select(key, F.col("input_hash").alias("hash_now"))
    df = frozen.join(n, key, "full")
    state = F.when(F.col("input_hash").isNull(), "added").when(F.col("hash_now").isNull(), "missing").when(F.col("input_hash") != F.col("hash_now"), "changed")
    return df.withColumn("state", state).filter("state is not null").select(key, "state")


def resolve_document(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """EVL12: the newest job of each base name."""
    base = F.lower(F.substring_index("file_name", "/", -1))
    last = jobs.groupBy(base.alias("base_name")).agg(F.max(F.struct("created_at", "job_id"))["job_id"].alias("job_id"))
    return names.withColumn("base_name", F.lower(F.substring_index("name", "/", -1))).join(last, "base_name", "left").select("name", "job_id")


def campaign_workload(workload: Column, suite: Column) -> Column:
    """EVL16: summarisation suites and workloads; everything else is interactive retrieval."""
    doc = "document_summarization"
    return F.when(F.lower(workload) == doc, F.lit(doc)).when((F.coalesce(workload, F.lit("")) == "") & F.lower(suite).rlike("^(summarization|summarize)"), F.lit(doc)).otherwise(F.lit("interactive_rag"))


def successful(c: DataFrame) -> DataFrame:
    ok = (F.coalesce(F.lower("status"), F.lit("")) != "failed") & (F.col("dry_run") | ~((F.coalesce("cost_usd", F.lit(0.0)) <= 0) & (F.coalesce("runtime_s", F.lit(0.0)) < 1)))
    return c.filter(ok)


def pick_campaigns(campaigns: DataFrame) -> DataFrame:
    """EVL13: the newest successful campaign of each workload."""
    return successful(campaigns).groupBy("workload").agg(F.max(F.struct("at", "campaign_id"))["campaign_id"].alias("campaign_id"))


def cross_workload_pair(campaigns: DataFrame) -> DataFrame:
    """EVL13: the newest retrieval campaign that shares a document with a summarisation campaign, and the newest such."""
    c = successful(campaigns)
    r = c.filter("workload = 'interactive_rag'").select("document_id", F.col("at").alias("ra"), F.col("campaign_id").alias("rag"))
    s = c.filter("workload = 'document_summarization'").select("document_id", F.col("at").alias("sa"), F.col("campaign_id").alias("summarization"))
    return r.join(s, "document_id").agg(F.max(F.struct("ra", "rag", "sa", "summarization")).alias("b")).select("b.rag", "b.summarization")


def campaign_totals(models: DataFrame, by: str = "campaign_id") -> DataFrame:
    """EVL14: CO2e and cost of a campaign; without a total, the mean times the runs."""
    n = F.greatest(F.lit(1), F.coalesce(F.nullif("n_ok", F.lit(0)), F.nullif("n_runs", F.lit(0)), F.lit(1)))
    co2 = F.coalesce(F.col("total_co2e_g"), F.coalesce("avg_co2e_g", F.lit(0.0)) * n)
    return models.groupBy(by).agg(F.sum(co2).alias("co2e_g"), F.sum(F.coalesce("total_cost_usd", F.lit(0.0))).alias("cost_usd"))


def tradeoff(models: DataFrame) -> DataFrame:
    """EVL15: speed, cost, carbon and throughput from 0 to 100, more is better; 50 where all are equal."""
    lo_hi = models.agg(*[f(F.coalesce(c, F.lit(0.0))).alias(f"{n}_{c}") for c in ("avg_latency_ms", "total_cost_usd", "avg_co2e_g", "avg_tokens_per_sec") for n, f in (("lo", F.min), ("hi", F.max))])

    def axis(c: str, invert: bool) -> Column:
        lo, hi, v = F.col(f"lo_{c}"), F.col(f"hi_{c}"), F.coalesce(c, F.lit(0.0))
        return F.when(hi == lo, 50.0).otherwise((hi - v if invert else v - lo) / (hi - lo) * 100)

    return models.crossJoin(F.broadcast(lo_hi)).select("model", axis("avg_latency_ms", True).alias("speed"), axis("total_cost_usd", True).alias("cost"), axis("avg_co2e_g", True).alias("carbon"), axis("avg_tokens_per_sec", False).alias("throughput"))


def pareto(models: DataFrame) -> DataFrame:
    """EVL17: models that no other beats in quality, latency, cost and CO2e at once."""
    cols = ("avg_quality_score", "avg_latency_ms", "total_cost_usd", "avg_co2e_g")
    o = models.select(*[F.col(c).alias(f"o_{c}") for c in cols])
    no_worse = (F.col("o_avg_quality_score") >= F.col("avg_quality_score")) & (F.col("o_avg_latency_ms") <= F.col("avg_latency_ms")) & (F.col("o_total_cost_usd") <= F.col("total_cost_usd")) & (F.col("o_avg_co2e_g") <= F.col("avg_co2e_g"))
    better = (F.col("o_avg_quality_score") > F.col("avg_quality_score")) | (F.col("o_avg_latency_ms") < F.col("avg_latency_ms")) | (F.col("o_total_cost_usd") < F.col("total_cost_usd")) | (F.col("o_avg_co2e_g") < F.col("avg_co2e_g"))
    return models.join(F.broadcast(o), no_worse & better, "left_anti")


def speedup_summary(runs: DataFrame) -> DataFrame:
    """EVL18: median and best of sequential over parallel time.

    A sketch brackets the median to under a thousandth of the rows (its ranks are off by 1 / 10,000 at most); the
    median is taken exactly from the bracket and the number of rows below it.
    """
    s = runs.filter("parallel_ms > 0").withColumn("speedup", F.col("sequential_ms") / F.col("parallel_ms"))
    b = s.agg(F.count("*").alias("n"), F.count("speedup").alias("k"), F.max("speedup").alias("best_speedup"), F.percentile_approx("speedup", [0.4997, 0.5003], 10000).alias("near"))
    marked = s.join(F.broadcast(b.select("near")), F.col("speedup") <= F.col("near")[1])
    # All rows below the bracket are one row here, with a null speedup, which sorts first.
    sizes = marked.groupBy(F.when(F.col("speedup") >= F.col("near")[0], F.col("speedup")).alias("speedup")).agg(F.count("*").alias("rows"))
    upto = sizes.withColumn("upto", F.sum("rows").over(Window.orderBy(F.asc_nulls_first("speedup"))))
    at = (F.col("k") - 1) / 2
    reach = lambda i: F.min(F.when(F.col("upto") > i, F.col("speedup")))
    one = b.join(F.broadcast(upto), F.lit(True), "left").groupBy("n", "best_speedup").agg(reach(F.floor(at)).alias("lower"), reach(F.ceil(at)).alias("upper"))
    return one.select("n", ((F.col("lower") + F.col("upper")) / 2).alias("median_speedup"), "best_speedup")


def freeze_window(chunks: DataFrame, max_chunks: int, budget: int) -> DataFrame:
    """EVL19: a document's first chunks in number order, joined by blank lines and cut at a character budget."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    df = chunks.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_chunks)
    start = F.coalesce(F.sum(F.length("content") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("from", start).filter(F.col("from") < budget).withColumn("part", F.substring("content", F.lit(1), (F.lit(budget) - F.col("from")).cast("int")))
    g = df.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "part"))), lambda x: x["part"]), "\n\n").alias("window_text"))
    return g.withColumn("window_text", F.substring("window_text", 1, budget))


def workload_points(rag: DataFrame, summarization: DataFrame) -> DataFrame:
    """EVL20: cost and CO2e of each model under both workloads."""
    one = lambda df, w: df.select(F.lit(w).alias("workload"), "model", F.col("total_cost_usd").alias("cost_usd"), F.coalesce("total_co2e_g", F.col("avg_co2e_g") * F.greatest(F.lit(1), "n_ok")).alias("co2e_g"))
    return one(rag, "interactive_rag").unionByName(one(summarization, "document_summarization"))


def freeze_retrieval(hits: DataFrame, chunks: DataFrame, budget: int = 2000) -> DataFrame:
    """EVL11: one retrieval and one packing a question, frozen: context, its tokens and its hash.

    hits: query_id, chunk_id, score, place; chunks: chunk_id, content, parent_id, section_path.
    """
    from .cgraph import written
    from .context import assemble_context, dedupe_passages, merge_siblings, normalize_passages, select_under_budget

    # Scores as they were ranked: the last bits of a sum must not decide which of two equal passages stays.
    p = written(written(hits).join(chunks, "chunk_id").withColumn("rank", F.col("place")).withColumn("score", F.round("score", 9)))
    packs, provenance = assemble_context(select_under_budget(merge_siblings(dedupe_passages(normalize_passages(p))), budget))
    used = provenance.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("chunk_ids"))
    return packs.join(used, "query_id").withColumn("context_hash", F.sha2("context_text", 256))
