"""Jobs, sessions, turns and result patches as tables.

Jobs have job_id, owner_id, status, created_at and, where used, available_at, heartbeat_at, claimed_at,
updated_at, attempt_count, progress. Clocks are arguments, so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("pending", "processing")
# Limits of listing, retries, retention of turns.
LIST_LIMIT, MAX_ATTEMPTS, BACKOFF_S, TURNS_KEPT = 200, 3, 30, 40
# Background phases, in order.
PHASES = ("queued", "indexing", "embeddings", "carbon", "analytics", "search_ready", "complete", "done")
EMPTY_WORDS = ("", "unknown", "—", "-", "none", "null")


def extract_metrics(jobs: DataFrame, payload: str = "payload") -> DataFrame:
    """JOB1: indexed metrics from the nested result, each with its fallbacks in order."""
    def first(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(payload, p) for p in paths])

    deep = "$.result.processing_insights."
    return jobs.select(
        "job_id",
        first("$.selected_model", deep + "selected_model", "$.routing_decision.selected_model").alias("selected_model"),
        *[first(f"$.{m}", deep + m).cast("double").alias(m) for m in ("crs", "confidence", "latency_ms")],
        first("$.carbon_saved_grams", "$.result.carbon_data.carbon_saved_grams").cast("double").alias("carbon_saved_grams"),
    )


def list_jobs(jobs: DataFrame, owner: int, active_only: bool = False, limit: int = LIST_LIMIT) -> DataFrame:
    """JOB2: an owner's newest jobs, pruned columns."""
    df = jobs.filter(F.col("owner_id") == owner)
    df = df.filter(F.col("status").isin(*ACTIVE)) if active_only else df
    return df.select("job_id", "status", "created_at", "progress").orderBy(F.desc("created_at"), F.desc("job_id")).limit(min(limit, LIST_LIMIT))


def next_jobs(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """JOB3: the n oldest pending jobs that may be claimed."""
    ready = F.col("available_at").isNull() | (F.col("available_at") <= now)
    return jobs.filter((F.col("status") == "pending") & ready).orderBy("created_at", "job_id").limit(n)


def heartbeat_age(now: Column) -> Column:
    seen = F.coalesce("heartbeat_at", "claimed_at", "updated_at")
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(seen))


def stale_jobs(jobs: DataFrame, now: Column, ttl_s: int = 60) -> DataFrame:
    """JOB4: processing jobs whose last sign of life is ttl_s old or older."""
    return jobs.filter(F.col("status") == "processing").withColumn("age_s", heartbeat_age(now)).filter(F.col("age_s") >= ttl_s)


def reclaim(jobs: DataFrame, now: Column, ttl_s: int = 60, most: int = MAX_ATTEMPTS, backoff_s: int = BACKOFF_S) -> DataFrame:
    """JOB5: stale jobs go back to pending with a growing delay, or to error after too many attempts."""
    stale = (F.col("status") == "processing") & (heartbeat_age(now) > ttl_s)
    spent = F.coalesce("attempt_count", F.lit(0)) >= most
    delay = backoff_s * F.greatest(F.coalesce("attempt_count", F.lit(0)), F.lit(1))
    return jobs.withColumns({
        "status": F.when(stale & spent, "error").when(stale, "pending").otherwise(F.col("status")),
        "error_detail": F.when(stale & spent, "stale_heartbeat_max_attempts").when(stale, "stale_heartbeat_requeued"),
        "wait_s": F.when(stale & ~spent, delay),
    })


def queue_snapshot(jobs: DataFrame, workers: DataFrame, now: Column, ttl_s: int = 60) -> DataFrame:
    """JOB6: workers alive and busy, jobs queued and processing; one row."""
    alive = F.unix_timestamp(now) - F.unix_timestamp("seen_at") <= ttl_s
    w = workers.agg(F.count_if(alive).alias("alive_workers"), F.count_if(alive & (F.col("current_job_id").isNotNull() | (F.col("status") == "busy"))).alias("busy_workers"))
    j = jobs.agg(F.count_if(F.col("status") == "pending").alias("queued"), F.count_if(F.col("status") == "processing").alias("processing"))
    return w.crossJoin(j)


def retention(jobs: DataFrame) -> DataFrame:
    """JOB7: the latest job of each owner is kept, the others are listed for purging.

    The latest is found by an aggregation and joined back, so an owner with very many jobs is no
    single task's work.
    """
    last = jobs.groupBy("owner_id").agg(F.max(F.struct("created_at", "job_id")).alias("last"))
    return jobs.join(last, "owner_id").select("owner_id", "job_id", (F.col("job_id") == F.col("last.job_id")).alias("keep"))


def expired_sessions(sessions: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """JOB8: sessions past their time, or marked so, that have no job under way."""
    due = ~F.col("status").isin("purged", "upgraded") & ((F.col("status") == "expired") | (F.col("expires_at") < now))
    running = jobs.filter(F.col("status").isin(*ACTIVE)).select(F.col("owner_id").alias("session_id"))
    out = sessions.filter(due).join(running, "session_id", "left_anti")
    return out.withColumn("status", F.when(F.col("status") == "active", "expired").otherwise(F.col("status")))


def transfer_owner(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """JOB9: owner_id replaced where (old_owner, new_owner) says so; `moved` marks the rows."""
    m = moves.select(F.col("old_owner").alias("owner_id"), "new_owner")
    return rows.join(m, "owner_id", "left").withColumn("moved", F.col("new_owner").isNotNull()).withColumn("owner_id", F.coalesce("new_owner", "owner_id")).drop("new_owner")


def purge_owners(tables: dict[str, DataFrame], owners: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """JOB10: the tables without the owners' rows, and how many went from each."""
    kept = {name: df.join(owners, "owner_id", "left_anti") for name, df in tables.items()}
    counts = [df.join(owners, "owner_id", "left_semi").agg(F.lit(name).alias("table_name"), F.count("*").alias("purged")) for name, df in tables.items()]
    report = counts[0]
    for c in counts[1:]:
        report = report.union(c)
    return kept, report


def trim_turns(turns: DataFrame, n: int = TURNS_KEPT) -> DataFrame:
    """JOB11: the last n turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n).drop("back")


def prior_entities(turns: DataFrame, entities: Column) -> DataFrame:
    """JOB12: distinct entities of a conversation in order of first mention."""
    e = turns.select("conv_id", "turn", F.posexplode(entities).alias("pos", "entity"))
    first = e.groupBy("conv_id", "entity").agg(F.min(F.struct("turn", "pos")).alias("at"))
    return first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity"))), lambda x: x["entity"]).alias("entities"))


def phase_rank(c: str) -> Column:
    m = F.create_map(*[F.lit(x) for i, p in enumerate(PHASES) for x in (p, i)])
    return F.coalesce(F.element_at(m, F.trim(F.lower(c))), F.lit(-1))


def is_empty(c: str) -> Column:
    return F.col(c).isNull() | F.trim(F.lower(c)).isin(*EMPTY_WORDS)


def merge_results(patches: DataFrame) -> DataFrame:
    """JOB13: one state a job from patches in any order.

    patches: job_id, seq, total_chunks, actual_g (numbers that only grow), final_summary (the longest,
    the later of equals), phase (by rank), search_ready (sticks), grid_zone and latency_ms (first that
    is not empty or zero).
    """
    has = lambda c: F.when(~is_empty(c), F.col(c))
    return patches.groupBy("job_id").agg(
        F.max("total_chunks").alias("total_chunks"),
        F.max("actual_g").alias("actual_g"),
        F.max(F.when(~is_empty("final_summary"), F.struct(F.length("final_summary").alias("n"), "seq", "final_summary")))["final_summary"].alias("final_summary"),
        F.max(F.when(~is_empty("phase"), F.struct(phase_rank("phase").alias("r"), "seq", "phase")))["phase"].alias("phase"),
        F.coalesce(F.bool_or("search_ready"), F.lit(False)).alias("search_ready"),
        F.min(F.when(has("grid_zone").isNotNull(), F.struct("seq", "grid_zone")))["grid_zone"].alias("grid_zone"),
        F.min(F.when(F.coalesce("latency_ms", F.lit(0.0)) != 0, F.struct("seq", "latency_ms")))["latency_ms"].alias("latency_ms"),
    )


def additive_merge(a: DataFrame, b: DataFrame, key: str, columns: list[str], wins: tuple[str, ...] = ()) -> DataFrame:
    """JOB14: a's numbers, filled from b where empty or zero; columns in `wins` come from b where it has them."""
    y = b.select(key, *[F.col(c).alias(f"{c}_b") for c in columns])
    pick = lambda c: F.coalesce(f"{c}_b", c) if c in wins else F.coalesce(F.nullif(c, F.lit(0)), f"{c}_b", c)
    return a.select(key, *columns).join(y, key, "full").select(key, *[pick(c).alias(c) for c in columns])


def tier_insights(telemetry: DataFrame) -> DataFrame:
    """JOB16: carbon, latency and count of a job by tier; a missing tier is medium."""
    return telemetry.groupBy("job_id", F.coalesce("tier", F.lit("medium")).alias("tier")).agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("carbon_g", F.lit(0.0))).alias("carbon_g"),
        F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("total_ms"), F.avg(F.coalesce("latency_ms", F.lit(0.0))).alias("avg_ms"),
    )


def budget_ledger(calls: DataFrame, budget: float) -> DataFrame:
    """JOB19: what a job has spent before each call, what is left, and whether the call may run."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    df = calls.withColumn("spent_g", F.coalesce(F.sum("carbon_g").over(w), F.lit(0.0)))
    df = df.withColumn("remaining_g", F.greatest(F.lit(0.0), F.lit(budget) - F.col("spent_g")))
    return df.withColumn("decision", F.when(F.col("remaining_g") > 0, F.lit("allowed")).otherwise(F.lit("skipped_budget")))


def revision_audit(writes: DataFrame) -> DataFrame:
    """JOB17: each write of a job's result against the one before: keys lost and gained, what went backwards.

    writes: job_id, seq, keys (flattened), baseline_g, actual_g, region, phase.
    """
    w = Window.partitionBy("job_id").orderBy("seq")
    before = lambda c: F.lag(c).over(w)
    df = writes.withColumns({"was_keys": before("keys"), "was_base": F.coalesce(before("baseline_g"), F.lit(0.0)), "was_actual": F.coalesce(before("actual_g"), F.lit(0.0)), "was_region": before("region"), "was_phase": phase_rank("phase")})
    df = df.withColumn("was_phase", F.lag("was_phase").over(w)).withColumn("revision", F.row_number().over(w))
    base, actual = F.coalesce("baseline_g", F.lit(0.0)), F.coalesce("actual_g", F.lit(0.0))
    codes = {
        "baseline_reset": (F.col("was_base") > 0) & (base < F.col("was_base") * 0.5) & (base <= 0.0001), "optimized_lost": (F.col("was_actual") > 0) & (actual <= 0),
        "region_disappeared": F.col("was_region").isNotNull() & F.col("region").isNull(), "phase_backwards": (phase_rank("phase") >= 0) & (phase_rank("phase") < F.col("was_phase")),
    }
    none = F.array().cast("array<string>")
    return df.select(
        "job_id", "revision", F.sha2(F.concat_ws("|", "phase", F.format_number(base, 4), F.format_number(actual, 4), F.coalesce("region", F.lit(""))), 256).alias("fingerprint"),
        F.size(F.array_except(F.coalesce("was_keys", none), "keys")).alias("lost"), F.size(F.array_except("keys", F.coalesce("was_keys", none))).alias("gained"),
        F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in codes.items()])).alias("violations"),
    )


def readiness(j: DataFrame) -> DataFrame:
    """JOB18: whether summary, metrics and search of a job are ready: job_id, status, phase, progress, message, baseline_g, final_summary."""
    m, p = F.lower(F.coalesce("message", F.lit(""))), F.lower(F.coalesce("phase", F.lit("")))
    search = p.isin("search_ready", "complete", "done") | m.rlike("search (ready|available)")
    metrics = search | ((F.coalesce("progress", F.lit(0)) >= 100) & (F.coalesce("baseline_g", F.lit(0.0)) > 0))
    summary = m.rlike("summary ready|search (ready|available)") | (F.col("status") == "complete") | (F.trim(F.coalesce("final_summary", F.lit(""))) != "")
    return j.select("job_id", summary.alias("summary_ready"), metrics.alias("metrics_ready"), search.alias("search_ready"))


def compact_metrics(jobs: DataFrame, result: str = "result") -> DataFrame:
    """JOB15: figures of a job's result, each from the first place that has it."""
    cd, rc, bd, ins = "$.carbon_data.", "$.carbon_data.report_card.", "$.carbon_data.breakdown.", "$.processing_insights."
    g = lambda *ps: F.coalesce(*[F.get_json_object(result, p).cast("double") for p in ps])
    base = F.coalesce(g(rc + "estimated_baseline_pipeline_emissions_g", cd + "estimated_baseline_pipeline_emissions_g", bd + "estimated_baseline_pipeline_emissions_g", bd + "baseline_co2e_g", cd + "baseline_cost_gco2e"), F.lit(0.0))
    best = F.coalesce(g(cd + "operational_co2e_g", rc + "estimated_optimized_pipeline_emissions_g", cd + "estimated_optimized_pipeline_emissions_g", bd + "estimated_optimized_pipeline_emissions_g", bd + "actual_co2e_g", cd + "actual_cost_gco2e"), F.lit(0.0))
    saved = F.coalesce(g(bd + "carbon_saved_g", cd + "carbon_saved_grams"), base - F.coalesce(g(cd + "modeled_co2e_g"), best))
    tier = lambda t: F.coalesce(g(bd + f"routing_impact.{t}_chunks", cd + f"routing_impact.{t}_chunks", ins + f"routing_distribution.{t}"), F.lit(0.0))
    chunks = F.coalesce(g(cd + "total_chunks", bd + "routing_impact.total_chunks", ins + "routing_distribution.total"), tier("light") + tier("medium") + tier("heavy"))
    region = F.coalesce(*[F.get_json_object(result, p) for p in (cd + "region_decision.selected_region_name", cd + "region_decision.selected_region.display_name", rc + "grid_zone", bd + "grid_zone", cd + "grid_zone", cd + "compute_location")], F.lit("—"))
    return jobs.select("job_id", base.alias("baseline_g"), best.alias("optimized_g"), saved.alias("saved_g"), F.coalesce(g(bd + "reduction_percent", cd + "efficiency_percent"), F.lit(0.0)).alias("reduction_pct"), region.alias("region"), chunks.alias("total_chunks"), *[tier(t).alias(t) for t in ("light", "medium", "heavy")])
