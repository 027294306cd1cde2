"""Compile trees and job graphs: grouping, levels, fingerprints, roll-ups, critical paths, timelines."""

from __future__ import annotations

import itertools
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cgraph import cut, written
from .running import exponential_average

# Smoothing of the planner's averages.
ALPHA = 0.25


def group_by_section(summaries: DataFrame) -> DataFrame:
    """HIE1: summaries of a document by section, sections in order of first appearance."""
    g = summaries.groupBy("doc_id", F.coalesce("section", F.lit("Document")).alias("section")).agg(F.min("chunk_index").alias("first"), F.count("*").alias("members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "summary"))), lambda x: x["summary"]), "\n").alias("text"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")))


def hierarchy_levels(leaves: DataFrame, fan_in: int, most: int = 16) -> DataFrame:
    """HIE3: (doc_id, idx, tokens) leaves -> nodes of every level until a document has fan_in nodes or fewer."""
    level = leaves.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("tokens").cast("long").alias("tokens"), F.lit(1).cast("long").alias("children"))
    out = level.withColumn("level", F.lit(0))
    for n in range(1, most + 1):
        many = level.groupBy("doc_id").count().filter(F.col("count") > fan_in).select("doc_id")
        level = cut(level.join(many, "doc_id", "left_semi").groupBy("doc_id", F.floor(F.col("idx") / fan_in).alias("idx")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("children")))
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out


def hierarchy_diag(nodes: DataFrame) -> DataFrame:
    """HIE4: nodes, mean and most children of each level."""
    return nodes.groupBy("doc_id", "level").agg(F.count("*").alias("nodes"), F.avg("children").alias("mean_children"), F.max("children").alias("most_children"), F.sum("tokens").alias("tokens"))


def dag_fingerprint(nodes: DataFrame) -> DataFrame:
    """HIE6: a hash of a job's topology: its nodes in order with kind and dependencies."""
    n = F.to_json(F.struct("node_id", "kind", F.array_sort("dep_ids").alias("deps")))
    return nodes.groupBy("job_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(n)), ""), 256).alias("fingerprint"))


def topology_diff(was: DataFrame, now: DataFrame) -> DataFrame:
    """HIE6: nodes added, removed or rewired."""
    a = was.select("job_id", "node_id", F.to_json(F.array_sort("dep_ids")).alias("a"))
    b = now.select("job_id", "node_id", F.to_json(F.array_sort("dep_ids")).alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "rewired")
    return a.join(b, ["job_id", "node_id"], "full").withColumn("change", state).filter("change is not null").select("job_id", "node_id", "change")


def dag_progress(nodes: DataFrame, statuses: list[str]) -> DataFrame:
    """HIE7: nodes of a job by kind and status."""
    return nodes.groupBy("job_id", "kind").pivot("status", statuses).agg(F.count(F.lit(1))).na.fill(0)


def carbon_rollups(nodes: DataFrame) -> DataFrame:
    """HIE8: grams by level, worker, model and kind, and totals, in one pass of grouping sets."""
    return nodes.sparkSession.sql("""
        SELECT job_id, depth, worker_id, model, kind, sum(carbon_g) AS carbon_g, sum(tokens) AS tokens, grouping_id() AS grp
        FROM {nodes} GROUP BY GROUPING SETS ((job_id, depth), (job_id, worker_id), (job_id, model), (job_id, kind), (job_id))""", nodes=nodes)


#: Rows of nodes and dependencies up to which a job's chains are followed inside its task.
SMALL_JOB = 512


def _heaviest_chain(rows) -> tuple[float | None, bool]:
    """The heaviest chain of one job's (job, node, dep, ms, is_node) rows, and whether it is left to rounds: large, or not of numbers alone."""
    ms, after, top, size = {}, {}, None, 0
    for i, (_, node, dep, weight, is_node) in enumerate(rows):
        if i >= SMALL_JOB or weight != weight:
            return None, True
        if not is_node:
            after.setdefault(dep, set()).add(node)
            continue
        size, top = size + 1, weight if top is None else max(top, weight)
        if node is not None:
            ms[node] = max(ms.get(node, weight), weight)
    front = ms
    for _ in range(1, size):
        reached: dict = {}
        for dep, best in front.items():
            for node in after.get(dep, ()):
                if node in ms:
                    reached[node] = max(reached.get(node, best + ms[node]), best + ms[node])
        if not reached:
            break
        top, front = max(top, *reached.values()), reached
    return top, False


def _job_chains(batches):
    """(job_id, critical_ms, large) of the jobs of sorted rows; jobs without a node are left out."""
    kind = None

    def rows():
        nonlocal kind
        for b in batches:
            kind = b.schema.field("job_id").type
            yield from zip(*(c.to_pylist() for c in b.columns))

    def batch(held):
        jobs, tops, large = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(jobs, kind), pa.array(tops, pa.float64()), pa.array(large, pa.bool_())], names=["job_id", "critical_ms", "large"])

    held = []
    for job, of_job in itertools.groupby(rows(), itemgetter(0)):
        top, large = _heaviest_chain(of_job)
        if large or top is not None:
            held.append((job, top, large))
        if len(held) == 4096:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """HIE9: longest chain of a job by latency.

    Rows of nodes and dependencies are dealt by job and read in a stream; a job of few rows is done there, so all of them take one
    pass. Jobs of more than SMALL_JOB rows are walked by rounds of joins. A chain has no more nodes than its job, so cyclic input ends too.
    """
    n = nodes.select("job_id", "node_id", F.lit(None).alias("dep"), F.coalesce("latency_ms", F.lit(0.0)).cast("double").alias("ms"), F.lit(True).alias("is_node"))
    e = edges.filter("dep <> node_id and job_id is not null").select("job_id", "node_id", "dep", F.lit(None).cast("double").alias("ms"), F.lit(False).alias("is_node"))
    dealt = n.unionByName(e).repartition("job_id").sortWithinPartitions("job_id")
    done = written(dealt.mapInArrow(_job_chains, f"job_id {dict(dealt.dtypes)['job_id']}, critical_ms double, large boolean"))
    large, small = done.filter("large").select("job_id"), done.filter("not large").select("job_id", "critical_ms")
    if large.isEmpty():
        return small
    # A null job meets nothing: it has no chain, only its heaviest node.
    of = lambda df: df.join(large, df["job_id"].eqNullSafe(large["job_id"]), "left_semi")
    return small.unionByName(_by_rounds(of(nodes), of(edges)))


def _by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Round i holds, for every node, the heaviest chain of i dependencies that ends there; rounds go on until no job has such a chain."""
    n = nodes.select("job_id", "node_id", F.coalesce("latency_ms", F.lit(0.0)).alias("ms"))
    e = edges.filter("dep <> node_id").select("job_id", "dep", "node_id").distinct()
    steps = cut(e.join(n, ["job_id", "node_id"]))
    sizes = cut(n.groupBy("job_id").agg(F.count("*").alias("size"), F.max("ms").alias("critical_ms")))
    front, tops = n.select("job_id", "node_id", F.col("ms").alias("best")), [sizes.select("job_id", "critical_ms")]
    for i in itertools.count(1):
        ends = front.join(sizes.filter(F.col("size") > i), "job_id", "left_semi").withColumnRenamed("node_id", "dep")
        front = cut(ends.join(steps, ["job_id", "dep"]).groupBy("job_id", "node_id").agg(F.max(F.col("best") + F.col("ms")).alias("best")))
        if front.isEmpty():
            break
        tops.append(front.groupBy("job_id").agg(F.max("best").alias("critical_ms")))
        if len(tops) == 32:
            tops = [cut(_heaviest(tops))]
    return _heaviest(tops)


def _heaviest(tops: list[DataFrame]) -> DataFrame:
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out.groupBy("job_id").agg(F.max("critical_ms").alias("critical_ms"))


def dag_perf(nodes: DataFrame, wall: DataFrame, workers: int) -> DataFrame:
    """HIE10: utilisation, speed-up, efficiency and the slowest node of a job."""
    g = nodes.groupBy("job_id").agg(F.sum("latency_ms").alias("sum_ms"), F.max(F.struct("latency_ms", (-F.col("node_id")).alias("k"), "node_id", "kind")).alias("slow"))
    g = g.join(wall, "job_id").withColumn("speedup", F.when(F.col("wall_ms") > 0, F.col("sum_ms") / F.col("wall_ms")).otherwise(0.0))
    return g.select("job_id", F.least(F.lit(1.0), F.col("speedup") / workers).alias("utilization"), "speedup", (F.col("speedup") / workers).alias("efficiency"), F.col("slow.node_id").alias("slowest_node"), F.col("slow.kind").alias("slowest_kind"))


def planner_ema(obs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """HIE11: (metric, seq, value) -> the exponential average of each metric, from its first value on. Negative values do not count."""
    return exponential_average(obs.filter("value >= 0"), ["metric"], [F.col("seq")], "value", alpha).select("metric", "ema", "n")


def plan_estimate(plans: DataFrame, workers: int, intensity: float, sec_per: float = 8.0, carbon_per: float = 0.02, runtime_s: float = 60.0, cost_usd: float = 0.01, api_calls: float = 20.0) -> DataFrame:
    """HIE12: runtime, grams and dollars of a plan of compile_nodes, from the planner's averages."""
    n = F.col("compile_nodes")
    waves = F.greatest(F.lit(1), F.floor((n + workers - 1) / workers))
    runtime = 0.6 * waves * max(0.5, sec_per) + 0.4 * runtime_s * (n / max(1.0, api_calls))
    return plans.select("job_id", F.greatest(F.lit(1.0), runtime).alias("runtime_s"), (n * carbon_per * (intensity / 500.0)).alias("carbon_g"), (cost_usd * (n / max(1.0, api_calls))).alias("cost_usd"))


def layer_gaps(nodes: DataFrame, layers: list[str]) -> DataFrame:
    """HIE13: idle time between the last finish of a layer and the first start of the next."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(layers) for x in (k, i)]), F.col("kind"))
    g = nodes.groupBy("job_id", "kind").agg(F.min("start_ms").alias("first"), F.max("end_ms").alias("last")).withColumn("layer", order)
    w = Window.partitionBy("job_id").orderBy("layer")
    return g.withColumn("next_kind", F.lead("kind").over(w)).withColumn("gap_ms", F.lead("first").over(w) - F.col("last")).filter("next_kind is not null").select("job_id", "kind", "next_kind", "gap_ms")


def execution_trace(nodes: DataFrame) -> DataFrame:
    """HIE14: nodes, failures, dependencies, cost and the slowest node that is no chunk, of each job."""
    slow = F.max(F.when(F.col("kind") != "chunk", F.struct("latency_ms", (-F.col("node_id")).alias("k"), "node_id")))["node_id"]
    return nodes.groupBy("job_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "error").alias("failed"), F.sum(F.size("dep_ids")).alias("edges"), F.sum("cost_usd").alias("cost_usd"), slow.alias("slowest_node"))


def execution_timeline(nodes: DataFrame) -> DataFrame:
    """HIE14: a row for each node in order of start: kind, status, depth, dependencies, model, tokens, cost, and times since the job's first start."""
    first = nodes.groupBy("job_id").agg(F.min("start_ms").alias("first"))
    t = nodes.join(first, "job_id")
    w = Window.partitionBy("job_id").orderBy("start_ms", "node_id")
    since = lambda c: (F.col(c) - F.col("first")).alias(c.replace("_ms", "ed_at_ms").replace("end", "finish"))
    return t.select(
        "job_id", F.row_number().over(w).alias("place"), "node_id", "kind", "status", "depth", "dep_ids", "model", "tokens", "carbon_g", "latency_ms",
        since("start_ms"), since("end_ms"), (F.col("status") == "error").alias("failed"),
    )


#: Why a node waited.
QUEUED, BLOCKED = "scheduler_queue_or_worker_capacity_after_deps_ready", "dependencies_unfinished"


def wait_audit(nodes: DataFrame, submits: DataFrame, least_ms: float = 2000.0) -> DataFrame:
    """HIE15: submissions that came least_ms or more after the last dependency that had ended by then.

    submits: (job_id, node_id, at_ms). Each dependency's state is that of the moment: it is unfinished if it has no end or
    ends later. submit_n counts a node's submissions in order, submits all of them; the reason is BLOCKED
    with the unfinished dependencies, or QUEUED.
    """
    w = Window.partitionBy("job_id", "node_id").orderBy("at_ms")
    s = submits.withColumn("submit_n", F.row_number().over(w)).withColumn("submits", F.count("*").over(Window.partitionBy("job_id", "node_id")))
    d = nodes.select("job_id", "node_id", F.explode("dep_ids").alias("dep"))
    ends = nodes.select("job_id", F.col("node_id").alias("dep"), "end_ms")
    at = s.join(d, ["job_id", "node_id"]).join(ends, ["job_id", "dep"], "left")
    done = F.coalesce(F.col("end_ms") <= F.col("at_ms"), F.lit(False))
    g = at.groupBy("job_id", "node_id", "submit_n", "submits", "at_ms").agg(
        F.count("*").alias("deps"), F.max(F.when(done, F.col("end_ms"))).alias("ready_ms"), F.array_sort(F.collect_list(F.when(~done, F.col("dep")))).alias("unfinished"),
    )
    g = g.withColumn("wait_ms", F.col("at_ms") - F.col("ready_ms")).filter(F.col("wait_ms") >= least_ms)
    return g.select("job_id", "node_id", "submit_n", "submits", "deps", "wait_ms", F.when(F.size("unfinished") > 0, BLOCKED).otherwise(QUEUED).alias("reason"), "unfinished")


def prompt_tokens(nodes: DataFrame, pending: Column = None, cap: int = 400) -> DataFrame:
    """HIE16: tokens of a node's prompt: finished children by their tokens, pending ones capped."""
    d = nodes.select("job_id", "node_id", F.explode("dep_ids").alias("dep"))
    c = nodes.select("job_id", F.col("node_id").alias("dep"), F.when(F.col("status") == "complete", F.col("tokens")).otherwise(F.least("tokens", F.lit(cap))).alias("t"))
    return d.join(c, ["job_id", "dep"]).groupBy("job_id", "node_id").agg(F.sum("t").alias("prompt_tokens"))


def overflow_layers(edges: DataFrame, budget: int, summary_cap: int = 400) -> DataFrame:
    """HIE5: (job_id, parent, child, tokens) -> edges with intermediate nodes under parents whose children exceed the budget.

    An overfull parent's children are dealt in order into nodes of budget / mean tokens children, two at
    least; a new node counts with its summary's cap. Repeats, for new nodes too, until no parent of more than two
    children is overfull: each turn leaves the parent fewer children and gives its new nodes fewer than it had.
    """
    now, done, turn = cut(edges.select("job_id", "parent", "child", F.col("tokens").cast("long").alias("tokens"))), None, 0
    while True:
        load = now.groupBy("job_id", "parent").agg(F.sum("tokens").alias("total"), F.count("*").alias("n"))
        over = cut(load.filter((F.col("total") > budget) & (F.col("n") > 2)))
        if over.isEmpty():
            return now if done is None else done.unionByName(now)
        settled = now.join(over, ["job_id", "parent"], "left_anti")
        done = settled if done is None else done.unionByName(settled)
        fan = F.greatest(F.lit(2), F.least(F.col("n") - 1, F.floor(F.lit(budget) / F.greatest(F.lit(80), F.floor(F.col("total") / F.col("n"))))))
        w = Window.partitionBy("job_id", "parent").orderBy("child")
        full = now.join(over, ["job_id", "parent"]).withColumn("batch", F.floor((F.row_number().over(w) - 1) / fan))
        node = F.concat_ws("/", F.lit("overflow"), "parent", F.lit(str(turn)), "batch")
        full = cut(full.select("job_id", "parent", "child", "tokens", node.alias("node")))
        lower = full.select("job_id", F.col("node").alias("parent"), "child", "tokens")
        upper = full.groupBy("job_id", "parent", F.col("node").alias("child")).agg(F.least(F.sum("tokens"), F.lit(summary_cap)).alias("tokens"))
        now, turn = cut(lower.unionByName(upper)), turn + 1
