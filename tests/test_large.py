"""Facts that only larger tables or odd rows bring out."""

import statistics

import numpy as np
import pyarrow as pa

from docflow.operators import cgraph, evaluation, nodesearch, quality, telemetry
from docflow.plans import graph_queries


def test_bottleneck_shares_do_not_depend_on_row_order(spark):
    ms = {"error": 52.68, "signup": 30.36, "click": 19.36}
    orders = [list(ms), list(ms)[::-1], ["signup", "click", "error"], ["click", "error", "signup"]]
    rows = [(n, stage, ms[stage]) for n, order in enumerate(orders) for stage in order]
    df = spark.createDataFrame(rows, "run_id long, stage string, ms double").coalesce(1)
    shares = {(r.stage, r.share) for r in telemetry.rank_bottlenecks(df).collect()}
    assert len(shares) == 3 and {("error", 51.4453125), ("signup", 29.6484375)} <= shares


def test_generation_in_no_time(spark):
    rows = [(1, 0.0, 0.0, 0.0, 7, []), (2, 0.0, 0.0, 0.0, 0, []), (3, 1.0, 3.0, 1.0, 4, [])]
    calls = spark.createDataFrame(rows, "call_id long, ttft_ms double, ttlt_ms double, first_byte_ms double, out_tokens long, attempts array<struct<ok:boolean,error:string>>")
    rates = lambda **kw: [r.tokens_per_sec for r in telemetry.generation_timing(calls, **kw).orderBy("call_id").collect()]
    assert rates() == [0.0, 0.0, 2000.0]
    assert rates(instant=True) == [float("inf"), 0.0, 2000.0]


def test_progress_in_no_time(spark):
    p = spark.createDataFrame([(8, 10, 0.0), (0, 10, 0.0), (0, 10, 2.0), (5, 10, 2.0)], "done long, total long, elapsed_s double")
    assert [(r.rate, r.eta_s) for r in telemetry.eta(p).collect()] == [(None, None), (None, None), (0.0, None), (2.5, 2.0)]
    got = [(str(r.rate), r.eta_s) for r in telemetry.eta(p, instant=True).collect()]
    assert got == [("inf", 0.0), ("nan", None), ("0.0", None), ("2.5", 2.0)]


def test_search_does_not_depend_on_blocks(spark, monkeypatch):
    v, _, q = graph_queries._searched(spark, "/root/testdata/sf0.001")
    odd = q.limit(2).selectExpr("-query_id - 1 as query_id", "'raedme-nte 4' as query")
    find = lambda: sorted(map(tuple, nodesearch.search_nodes(v, q.union(odd)).collect()))
    whole = find()
    monkeypatch.setattr(nodesearch, "VERTICES", 60)
    monkeypatch.setattr(nodesearch, "QUERIES", 2)
    assert find() == whole and {r[0] for r in whole} >= {-1}


def test_edits(spark):
    texts = ["", "a", "part12", "make_part_12", "aprt21", "store", "ab" * 40]
    want = {(r.a, r.b): r.n for r in spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").selectExpr("a", "b", "levenshtein(a, b) n").collect()}
    for a in texts:
        masks = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in a}
        assert all(nodesearch.edits(masks, len(a), b) == want[a, b] for b in texts)


def test_modules_hold_no_members_by_query(spark, monkeypatch):
    v, e, q = graph_queries._searched(spark, "/root/testdata/sf0.001")
    many = q.crossJoin(spark.range(100).withColumnRenamed("id", "n")).selectExpr("query_id * 100 + n as query_id", "query")
    sizes = []
    kept = nodesearch.cut
    monkeypatch.setattr(nodesearch, "cut", lambda df: (out := kept(df), sizes.append(out.count()))[0])
    got = {r.query_id: r.asDict() for r in nodesearch.module_summary(v, e, many).collect()}
    one = {r.query_id: r.asDict() for r in nodesearch.module_summary(v, e, q).collect()}
    assert all({**got[i * 100 + 7], "query_id": i} == row for i, row in one.items()) and len(got) == 100 * len(one)
    assert max(sizes) <= 2 * (e.count() + v.count()) < sum(r["members"] for r in got.values())


def test_median_speedup_in_no_single_buffer(spark):
    runs = lambda xs: spark.createDataFrame([(x, 2.0) for x in xs], "sequential_ms double, parallel_ms double")
    for xs in ([3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [4.0, 4.0, 1.0, 9.0], [float(i * 7919 % 1000) for i in range(1000)], [1.0] * 900 + [7.0] * 100):
        n, median, best = evaluation.speedup_summary(runs(xs)).first()
        assert (n, median, best) == (len(xs), statistics.median(xs) / 2, max(xs) / 2)
    assert tuple(evaluation.speedup_summary(runs([])).first()) == (0, None, None)
    plan = evaluation.speedup_summary(runs([1.0]))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_escalations_make_each_metric_once(spark, tables):
    # A filter below the metrics would name every expression again, many times over.
    docs = tables("documents").selectExpr("doc_id as pair_id", "source as job_id", "text as source", "substr(text, 1, 80) as summary")
    every = quality.validate_pairs(docs)
    found = quality.pick_escalations(every, 2)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert plan(found) <= plan(every)
    want = sorted(every.filter("not passed").selectExpr("job_id", "round(confidence, 9) as c", "pair_id").collect())
    got = sorted((r.job_id, r.place, r.pair_id) for r in found.select("job_id", "place", "pair_id").collect())
    jobs = sorted({r.job_id for r in want})
    assert got == sorted((j, n, r.pair_id) for j in jobs for n, r in enumerate([r for r in want if r.job_id == j][:2], 1))


def test_distances_to_many_labels_at_once():
    labels = ["", "a", "part12", "make_part_12", "aprt21", "store", "ab" * 40, "größe 7", *(f"make_part_{n}" for n in range(300))]
    names = nodesearch.Labels(labels)
    for text in ["", "b", "mkae_prat_12", "größen", "part 21 store", "ba" * 32, "ba" * 33]:
        masks = {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in text}
        some = np.array([i for i in range(len(labels)) if i % 7 != 3])
        assert names.distances(text, some).tolist() == [nodesearch.edits(masks, len(text), labels[i]) for i in some]


def test_partial_ratio_is_told_early():
    texts = ["", "a", "part12", "make_part_12", "mkae_prat_12", "aprt21", "store", "readme note 12", "raedme-nte12", "12 part", "abcabcabc", "cab"]
    for least in (35.0, 50.0, 70.0, 90.0):
        assert all(nodesearch.reaches(a, b, least) == (nodesearch.partial_ratio(a, b) >= least) for a in texts for b in texts if a and b)


def test_search_tries_labels_many_at_a_time(spark, monkeypatch):
    v, _, q = graph_queries._searched(spark, "/root/testdata/sf0.001")
    v, q = v.toPandas(), q.toPandas()
    norm = lambda s: s.str.lower().str.replace(r"[^a-z0-9_./\\+\-]+", " ", regex=True).str.strip()
    block = pa.table({"id": v.id, "lid": v.id, "ll": v.label.str.lower(), "nl": norm(v.label), "lf": v.source_file, "allowed": [True] * len(v), "by_degree": (0.3 * v.degree).clip(upper=10), "by_length": [0.0] * len(v), "by_kind": [8.0] * len(v)})
    asked = pa.table({"query": q["query"], "qn": norm(q["query"]), "lq": q["query"].str.lower()})
    monkeypatch.setattr(nodesearch, "edits", None)
    assert all(len(best) == 20 for _, _, best in nodesearch.best_of_block(block, asked, 20, None))


def test_files_of_an_impact_need_no_rows_of_the_last_step(spark, monkeypatch):
    # A star: every leaf reaches all leaves of its hub in two steps; a loop, and a vertex that only leads back to itself.
    e = [(f"leaf{h}_{i}", f"hub{h}", "uses") for h in range(3) for i in range(30)] + [(f"hub{h}", f"leaf{h}_{i}", "uses") for h in range(3) for i in range(30)]
    e += [("a", "b", "contains"), ("b", "b", "calls"), ("b", "c", "method"), ("d", "a", "calls"), ("x", "a", "uses")]
    names = sorted({n for s, d, _ in e for n in (s, d)} - {"x"})
    v = spark.createDataFrame([(n, None if n == "d" else f"f{sum(map(ord, n)) % 7}") for n in names] + [("alone", "f1")], "id string, source_file string")
    e = spark.createDataFrame(e, "src string, dst string, relation string")
    sizes, kept = [], cgraph.cut
    monkeypatch.setattr(cgraph, "cut", lambda df: (out := kept(df), sizes.append(out.count()))[0])
    for depth in (1, 2, 3):
        want = sorted(map(tuple, cgraph.affected_files(cgraph.impact(e, v.select("id"), depth), v).select("root", "source_file", "distance").collect()))
        whole = max(sizes)
        sizes.clear()
        assert sorted(map(tuple, cgraph.impact_files(e, v.select("id"), v, depth).select("root", "source_file", "distance").collect())) == want
        assert depth != 2 or max(sizes) < whole / 10
        sizes.clear()
