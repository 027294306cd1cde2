"""Facts of single operators on small tables, and properties that hold whatever the order of rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators import carbon, cgraph, context, evaluation, hierarchy, jobs, kgraph, quality, retrieval, routing, structure, traffic
from docflow.sources import documents as sources


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_token_estimates(spark):
    assert one(spark, T.est_tokens("t"), t="abcd") == 1 and one(spark, T.est_tokens("t"), t="a" * 40) == 10
    assert one(spark, T.est_tokens("t"), t="") == 1 and one(spark, T.est_tokens0("t"), t="") == 0


def test_json_repair(spark):
    assert one(spark, T.repair_json("t"), t='Here:\n```json\n{"a": [1, 2,],}\n```') == '{"a": [1, 2]}'
    assert one(spark, T.repair_json("t"), t="no object") is None


@pytest.mark.parametrize("q, kind", [("Summarize the report", "summary"), ("Compare A and B for me please now", "comparison"), ("who is it", "fact"), ("Explain in detail how the whole thing works for us", "explanation"), ("words that fall into no class at all here today", "default")])
def test_response_classes(spark, q, kind):
    assert one(spark, T.response_plan("q")[0], q=q) == kind


def test_extract_cuts_back_to_a_separator(spark):
    long = "word " * 400
    out = one(spark, T.extractive_summary("t"), t=long)
    assert out.endswith("word…") and one(spark, T.extractive_summary("t"), t=" ") == ""


def test_headings_and_uploads(spark):
    rows = [("1. PROBLEM STATEMENT", True), ("Retrieval Techniques", True), ("a plain sentence here", False), ("Ends here.", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("want", sources.looks_like_heading("t").alias("got")).collect()
    assert all(r.want == r.got for r in got)
    files = spark.createDataFrame([(1, "a.pdf", "%PDF-1"), (2, "b.pdf", "x"), (3, "c.txt", "<html>")], "file_id int, name string, content string")
    assert {r.file_id: r.reason for r in sources.validate_uploads(files).collect()} == {1: None, 2: "not_a_pdf", 3: "markup_in_text"}


def test_bad_json_lines_are_skipped(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in sources.read_events(spark, str(tmp_path), "a int").collect()) == [1, 2]
    sources.write_events(spark.createDataFrame([(3,)], "a int"), str(tmp_path))
    assert sources.read_events(spark, str(tmp_path), "a int").count() == 3


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([("s", "c1", "carbon grid intensity is high"), ("s", "c2", "cats sleep"), ("s", "c3", "grid of carbon atoms")], "scope string, chunk_id string, text string")
    q = spark.createDataFrame([(1, "s", "carbon grid intensity")], "query_id int, scope string, query string")
    hits = {r.chunk_id: r.score for r in retrieval.bm25_search(docs, q, 2).collect()}
    assert set(hits) == {"c1", "c3"} and hits["c1"] > hits["c3"]
    lists = [(1, 1, "d1"), (1, 2, "d2"), (1, 3, "d3"), (1, 1, "d2"), (1, 2, "d4"), (1, 3, "d1")]
    schema = "query_id int, place int, chunk_id string"
    a = retrieval.rrf(spark.createDataFrame(lists, schema)).collect()
    b = retrieval.rrf(spark.createDataFrame(lists[::-1], schema)).collect()
    assert len(a) == 4 and a[0].chunk_id in ("d1", "d2") and {(r.chunk_id, r.place) for r in a} == {(r.chunk_id, r.place) for r in b}


PASSAGE = "query_id int, chunk_id string, content string, score double, rank int, parent_id string, section_path string"


def test_repeated_passages_keep_the_better_one(spark):
    text = "the quick brown fox jumps over the lazy dog near the river"
    p = spark.createDataFrame([(1, "a", text, 0.5, 0, None, None), (1, "b", text + " bank", 0.9, 1, None, None), (1, "c", "other things entirely", 0.1, 2, None, None)], PASSAGE)
    assert {r.chunk_id for r in context.dedupe_passages(p).collect()} == {"b", "c"}


def test_budget_skips_what_does_not_fit(spark):
    rows = [(1, str(i), "x" * (4 * n), s, i, None, None) for i, (n, s) in enumerate([(40, 0.9), (90, 0.8), (30, 0.7)])]
    blocks = context.merge_siblings(spark.createDataFrame(rows, PASSAGE))
    kept = context.select_under_budget(blocks, 100).collect()
    assert {r.chunk_ids[0] for r in kept} == {"0", "2"}
    alone = context.select_under_budget(blocks.filter("score = 0.8"), 20).collect()
    assert len(alone) == 1 and len(alone[0].content) == 80


def test_stage_grams_add_up_and_tiers_rank(spark):
    j = spark.createDataFrame([(t, 1000, 350, 300, 1250 if t == "light" else 0, 1250 if t == "medium" else 0, 1250 if t == "heavy" else 0, 300, t, 0, 300, 643.0, 1250) for t in ("light", "medium", "heavy")], "job_id string, input_tokens int, retrieved_tokens int, generated_tokens int, light_tokens int, medium_tokens int, heavy_tokens int, compile_tokens int, compile_tier string, escalated int, verification_tokens int, intensity double, map_tokens int")
    got = {r.job_id: r for r in carbon.workflow_carbon(j).collect()}
    assert got["light"].saved_g > got["medium"].saved_g > got["heavy"].saved_g
    s = carbon.stage_co2(carbon.green_energy(j)).first()
    assert abs(sum(s[f"{x}_gco2e"] for x in (*carbon.STAGES, "infrastructure")) - s.total_gco2e) < 1e-9
    assert abs(s.total_gco2e - s.total_kwh * 643.0) < 1e-9


def test_attribution_gives_the_rest_to_the_last_chunk(spark):
    c = spark.createDataFrame([("j", i, 10, 30, "light", 700.0) for i in range(3)], "job_id string, chunk_index int, tokens int, input_tokens int, tier string, intensity double")
    assert [r.map_tokens for r in carbon.chunk_attribution(c).orderBy("chunk_index").collect()] == [12, 12, 13]


def test_merged_results_do_not_depend_on_order(spark):
    rng = random.Random(1)
    rows = [(1, i, rng.randrange(9), rng.random(), "s" * rng.randrange(5), rng.choice(jobs.PHASES), rng.random() < 0.2, rng.choice(["", "z1", "z2"]), rng.choice([0.0, 5.0, 7.0])) for i in range(30)]
    schema = "job_id int, seq int, total_chunks int, actual_g double, final_summary string, phase string, search_ready boolean, grid_zone string, latency_ms double"
    first = jobs.merge_results(spark.createDataFrame(rows, schema)).first()
    for _ in range(3):
        rng.shuffle(rows)
        assert jobs.merge_results(spark.createDataFrame(rows, schema)).first() == first


def test_limiter_does_not_count_denied_hits(spark):
    log = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 1, 2, 3, 61.5, 62.5])], "key long, event_id long, t double")
    out = {r.event_id: r.allowed for r in traffic.rate_limit(log, 2, 60.0).collect()}
    assert out == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_seeds_reach_neighbours_over_sure_edges(spark):
    n = spark.createDataFrame([("d", "e1", "Acme Corp", ["Acme"], ["c1"]), ("d", "e2", "Policy Board", [], ["c2"]), ("d", "e3", "Elsewhere", [], ["c3"])], "doc_id string, node_id string, name string, aliases array<string>, chunk_ids array<string>")
    e = spark.createDataFrame([("d", "e1", "R", "e2", 0.9, ["c4"]), ("d", "e1", "R", "e3", 0.1, ["c5"])], "doc_id string, src string, rel string, dst string, confidence double, chunk_ids array<string>")
    q = spark.createDataFrame([(1, "d", "Tell me about Acme Corp")], "query_id int, doc_id string, query string")
    assert {r.chunk_id for r in kgraph.neighbor_chunks(q, n, e).collect()} == {"c1", "c2", "c4"}
    up = kgraph.upsert_edges(e.limit(1).withColumn("confidence", F.lit(0.4)), e.limit(1).withColumn("confidence", F.lit(0.8)).withColumn("chunk_ids", F.array(F.lit("c9")))).first()
    assert up.confidence == 0.8 and up.chunk_ids == ["c4", "c9"]


def test_summaries_of_their_source_pass(spark):
    src = "Carbon aware routing lowers energy use because small models answer simple questions while large models answer difficult questions"
    p = spark.createDataFrame([(1, src, src), (2, src, "Bananas grow quickly under tropical sunshine without fertiliser")], "pair_id int, source string, summary string")
    got = {r.pair_id: r for r in quality.validate_pairs(p).collect()}
    assert got[1].passed and not got[2].passed and "high_hallucination" in got[2].codes


def test_exact_answers_score_full_marks(spark):
    p = spark.createDataFrame([(1, "The answer is 42", "the answer  is 42", "The answer is 42."), (2, None, "x", "y"), (3, "ref text", "", "y")], "pair_id int, reference string, candidate string, context string")
    got = {r.pair_id: r for r in evaluation.composite(p).collect()}
    assert got[1].quality_score == 100 and got[2].skipped and got[2].quality_score is None and got[3].quality_score == 0


def test_components_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a")], "src string, dst string")
    assert {(r.id, r.component) for r in cgraph.scc(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}


def test_betweenness_of_a_path_from_all_sources(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert {r.id: r.betweenness for r in cgraph.betweenness(e, 4).collect()} == {"a": 0, "b": 4, "c": 4, "d": 0}


def test_loops_run_until_they_settle(spark):
    ring = spark.createDataFrame([(f"n{i:03d}", f"n{(i + 1) % 70:03d}") for i in range(70)], "src string, dst string")
    assert Counter(r.component for r in cgraph.scc(ring).collect()) == {"n000": 70}
    chain = spark.createDataFrame([("j", i, 1.0) for i in range(80)], "job_id string, node_id int, latency_ms double")
    deps = spark.createDataFrame([("j", i, i + 1) for i in range(79)], "job_id string, dep int, node_id int")
    assert [r.critical_ms for r in hierarchy.critical_path(chain, deps).collect()] == [80.0]
    line = spark.createDataFrame([(f"v{i}", f"v{i + 1}") for i in range(12)], "src string, dst string")
    pairs = spark.createDataFrame([("v0", "v12"), ("v12", "v1"), ("v3", "w")], "src string, dst string")
    assert {(r.src, r.dst): r.hops for r in cgraph.shortest_paths(line, pairs).collect()} == {("v0", "v12"): 12, ("v12", "v1"): 11, ("v3", "w"): None}


def test_critical_path_ends_on_cycles(spark):
    n = spark.createDataFrame([("j", i, float(i)) for i in (1, 2, 3)] + [("k", 1, 1.0), ("k", 2, 2.0)], "job_id string, node_id int, latency_ms double")
    e = spark.createDataFrame([("j", 1, 2), ("j", 2, 3), ("k", 1, 2), ("k", 2, 1)], "job_id string, dep int, node_id int")
    got = {r.job_id: r.critical_ms for r in hierarchy.critical_path(n, e).collect()}
    assert got["j"] == 6.0 and got["k"] >= 3.0


def test_rollups_agree_across_grouping_sets(spark, tables):
    from docflow.plans.catalog import QUERIES

    rows = QUERIES["hie8_carbon_rollups"](spark, "/root/testdata/sf0.001").collect()
    total = sum(r.carbon_g for r in rows if r.depth is None and r.worker_id is None and r.model is None and r.kind is None)
    assert abs(total - sum(r.carbon_g for r in rows if r.kind is not None)) < 1e-6


def test_budget_demotes_later_chunks(spark):
    f = spark.createDataFrame([("d", i, 0.9, 0.9, 0.9, 4, "legal", 1500) for i in range(5)], "doc_id string, chunk_index int, complexity double, importance double, technical_density double, equation_count int, section_type string, token_count int")
    tiers = [r.tier for r in routing.route_chunks(f, budget_g=0.5).orderBy("chunk_index").collect()]
    assert tiers[0] == "heavy" and "heavy" not in tiers[1:]


def test_even_groups(spark):
    c = spark.createDataFrame([("d", i, str(i)) for i in range(7)], "doc_id string, chunk_index int, content string")
    assert [r.content for r in structure.force_cap(c, 3).orderBy("chunk_index").collect()] == ["0\n\n1", "2\n\n3", "4\n\n5\n\n6"]
