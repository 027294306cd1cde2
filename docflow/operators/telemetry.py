"""Durations, bottlenecks, concurrency and before/after comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import est_tokens


def stage_summary(timings: DataFrame, by: str = "stage", ms: str = "ms") -> DataFrame:
    """TEL1: n, mean, p50, p95, max, min of each stage; percentiles by linear interpolation."""
    p = F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95)))
    g = timings.groupBy(by).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean"), p.alias("p"), F.max(ms).alias("max"), F.min(ms).alias("min"))
    return g.select(by, "n", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "max", "min")


def rank_bottlenecks(timings: DataFrame, n: int = 10, plain: bool = False) -> DataFrame:
    """TEL2: a run's slowest stages with their share of all; the total is no stage.

    plain: times are added as doubles from the slowest stage down, and of no time at all there is no share (NaN).
    """
    t = timings.filter("stage <> 'total_ms'")
    w = Window.partitionBy("run_id")
    slowest = w.orderBy(F.desc_nulls_last("ms"), "stage")
    if plain:
        whole = F.sum("ms").over(slowest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        t = t.withColumn("whole", whole).withColumn("share", ieee_divide(F.col("ms"), F.col("whole")) * 100)
    else:
        # Summed as decimals: a sum of doubles depends on the order of the rows, which may tip a rounded share.
        whole = F.sum(F.col("ms").cast("decimal(28,12)")).over(w).cast("double")
        t = t.withColumn("share", F.col("ms") * 100 / F.coalesce(F.nullif(whole, F.lit(0.0)), F.lit(1.0)))
    return t.withColumn("place", F.row_number().over(slowest)).filter(F.col("place") <= n).select("run_id", "stage", "place", "ms", "share")


def waterfall(timings: DataFrame, width: int = 40) -> DataFrame:
    """TEL3: bars relative to a run's slowest stage; a stage that took any time has one mark at least."""
    t = timings.filter("stage <> 'total_ms' and ms is not null")
    peak = F.max("ms").over(Window.partitionBy("run_id"))
    marks = F.when(F.col("ms") > 0, F.greatest(F.lit(1), F.rint(F.col("ms") / peak * width).cast("int"))).otherwise(F.lit(0))
    return t.select("run_id", "stage", marks.alias("marks"), F.repeat(F.lit("█"), marks).alias("bar"))


def merge_latency(parts: DataFrame) -> DataFrame:
    """TEL4: (run_id, seq, stage, ms) -> one value a stage, the later part's."""
    return parts.groupBy("run_id", "stage").agg(F.max_by("ms", "seq").alias("ms"))


def stage_share(timings: DataFrame, total: str = "total_ms") -> DataFrame:
    """TEL5: mean of each stage over the mean of the total."""
    m = timings.groupBy("stage").agg(F.avg("ms").alias("mean_ms"))
    t = m.filter(F.col("stage") == total).select(F.col("mean_ms").alias("total"))
    return m.filter(F.col("stage") != total).crossJoin(F.broadcast(t)).select("stage", "mean_ms", (F.col("mean_ms") / F.col("total")).alias("share"))


def peak_concurrency(intervals: DataFrame) -> DataFrame:
    """TEL6: (run_id, start_ms, end_ms) -> the most intervals open at once; an end frees before a start."""
    marks = F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("step")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("step")))
    e = intervals.select("run_id", F.explode(marks).alias("e")).groupBy("run_id", "e.t").agg(F.sum(F.when(F.col("e.step") > 0, 1).otherwise(0)).alias("ins"), F.sum(F.when(F.col("e.step") < 0, 1).otherwise(0)).alias("outs"))
    w = Window.partitionBy("run_id").orderBy("t")
    e = e.withColumn("active", F.sum(F.col("ins") - F.col("outs")).over(w))
    return e.groupBy("run_id").agg(F.max("active").alias("peak"))


def call_stats(calls: DataFrame) -> DataFrame:
    """TEL7: calls, failures, latency of each job."""
    return calls.groupBy("job_id").agg(F.count("*").alias("calls"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failures"), F.avg("call_ms").alias("avg_ms"), F.max("call_ms").alias("max_ms"))


def io_wait(wall_ms: Column, cpu_ms: Column) -> Column:
    """TEL8: what a stage waited: wall time without CPU time, never below 0."""
    return F.greatest(F.lit(0.0), wall_ms - cpu_ms)


def compare_runs(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """TEL9: mean and sample deviation of each stage before and after, improvement, and target met or not."""
    side = lambda df, s: df.groupBy("stage").agg(F.avg("ms").alias(f"{s}_mean"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias(f"{s}_sd"))
    df = side(before, "before").join(side(after, "after"), "stage", "full").join(F.broadcast(targets), "stage", "left")
    df = df.withColumn("improvement_pct", F.when(F.col("before_mean") > 0, (F.col("before_mean") - F.col("after_mean")) / F.col("before_mean") * 100))
    return df.withColumn("status", F.when(F.col("target_ms").isNull(), "no_target").when(F.col("after_mean") <= F.col("target_ms"), "pass").otherwise("fail"))


def status_distribution(rows: DataFrame, status: str) -> DataFrame:
    """TEL9: how often each status came; rows without one do not count."""
    return rows.filter(F.col(status).isNotNull() & (F.col(status) != "")).groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles: by zero it is infinite, zero by zero is NaN."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def eta(progress: DataFrame, instant: bool = False) -> DataFrame:
    """TEL11: rate and seconds left; null while nothing is done or no time has passed.

    instant: what is done in no time at all has an infinite rate, and no seconds are left; any other time divides as it is.
    """
    if instant:
        rate = ieee_divide(F.col("done"), F.col("elapsed_s"))
        left = F.when(F.col("done") > 0, ieee_divide(F.col("total") - F.col("done"), F.col("rate")))
    else:
        rate = F.when(F.col("elapsed_s") > 0, F.col("done") / F.col("elapsed_s"))
        left = F.when((F.col("rate") > 0) & (F.col("done") > 0), (F.col("total") - F.col("done")) / F.col("rate"))
    return progress.withColumn("rate", rate).withColumn("eta_s", left)


def generation_timing(calls: DataFrame, instant: bool = False) -> DataFrame:
    """TEL10: inference, network and generation times, tokens a second after the first token, errors retried.

    calls: call_id, ttft_ms, ttlt_ms, first_byte_ms, out_tokens, attempts (ok, error). Tokens without a time
    of generation have no rate (0). With `instant` they have an infinite one, and times are taken as measured: an unknown one
    stays unknown, and one that ran backwards is not raised to 0.
    """
    errors = F.transform(F.filter("attempts", lambda a: ~a["ok"] & a["error"].isNotNull()), lambda a: a["error"])
    tokens = F.col("out_tokens")
    if instant:
        first, inference, gen = F.col("first_byte_ms"), F.col("ttlt_ms") - F.col("first_byte_ms"), F.col("ttlt_ms") - F.col("ttft_ms")
        rate = F.when(tokens > 0, ieee_divide(tokens, gen / 1000.0)).otherwise(F.lit(0.0))
    else:
        ttft = F.coalesce("ttft_ms", F.lit(0.0))
        ttlt, first = F.coalesce("ttlt_ms", ttft), F.coalesce("first_byte_ms", ttft)
        inference, gen = F.greatest(F.lit(0.0), ttlt - first), F.greatest(F.lit(0.0), ttlt - ttft)
        rate = F.when((gen > 0) & (tokens > 0), tokens / (gen / 1000.0)).otherwise(F.lit(0.0))
    return calls.select("call_id", first.alias("network_ms"), inference.alias("inference_ms"), gen.alias("generation_ms"), rate.alias("tokens_per_sec"), F.array_join(errors, ",").alias("retry_reasons"))


def prompt_token_parts(calls: DataFrame) -> DataFrame:
    """TEL10: tokens of a prompt by part: system texts, the user's query, retrieved context, the final prompt, output.

    calls: call_id, messages (role, content), query, context_tokens, out_tokens, max_tokens. Texts of a role are joined first.
    """
    of = lambda role: F.array_join(F.transform(F.filter("messages", lambda m: F.lower(m["role"]) == role), lambda m: F.coalesce(m["content"], F.lit(""))), "")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    system = est_tokens(of("system"))
    return calls.select(
        "call_id", system.cast("long").alias("system_tokens"), est_tokens("query").cast("long").alias("user_query_tokens"), zero("context_tokens").alias("retrieved_context_tokens"),
        (system + est_tokens(of("user"))).cast("long").alias("final_prompt_tokens"), zero("out_tokens").alias("output_tokens"), F.col("max_tokens").cast("long").alias("max_tokens_cap"),
    )
