"""Running aggregates, endpoint state, waits, evaluators, the table function and uploads, on hand-made rows."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docflow.operators import cgraph, evaluators, hierarchy, routing, running
from docflow.operators.tablefunctions import register_table_functions
from docflow.plans import graph_queries
from docflow.sources import documents


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("abc"), i, rng.choice([None, *map(float, range(9))])) for i in rng.sample(range(100_000), 6000)] + [(None, 7, 1.0), (None, 3, 2.0)]
    return spark.createDataFrame(rows, "key string, seq long, value double").repartition(5), rows


def test_positions(log):
    df, rows = log
    got = running.numbered(df, ["key"], [F.col("seq")]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        want |= {(k, s): i for i, (_, s, _) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1]))}
    assert {(r.key, r.seq): r.pos for r in got} == want and len(got) == len(rows)


def test_averages_and_moving_means(log, monkeypatch):
    df, rows = log
    monkeypatch.setattr(running, "BUCKET", 50)
    ema, mean = {}, {}
    for k in {r[0] for r in rows if r[0]}:
        own, x = [v for _, s, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])], None
        for v in own:
            if v is not None:
                x = v if x is None else 0.75 * x + 0.25 * v
        ema[k] = x
        seqs = sorted(r[1] for r in rows if r[0] == k)
        for i, s in enumerate(seqs):
            last = [v for v in own[max(0, i - 6) : i + 1] if v is not None]
            mean[k, s] = sum(last) / len(last) if last else None
    got = {r.key: r.ema for r in running.exponential_average(df.filter("key is not null"), ["key"], [F.col("seq")], "value", 0.25).collect()}
    assert got.keys() == ema.keys() and all(abs(got[k] - ema[k]) < 1e-9 for k in ema)
    out = {(r.key, r.seq): r.m for r in running.moving_mean(df.filter("key is not null"), ["key"], [F.col("seq")], "value", 7, "m").collect()}
    assert out.keys() == mean.keys() and all(out[k] == mean[k] or abs(out[k] - mean[k]) < 1e-9 for k in mean)


def test_endpoints(spark):
    call = "endpoint string, call_id long, started_s double, ended_s double, ok boolean, latency_ms double, ttft_ms double, tokens long, rate_limited boolean"
    rows = [
        ("idle", 1, 0.0, 10.0, True, 1000.0, 400.0, 50, False), ("idle", 2, 20.0, 30.0, True, 2000.0, 0.0, 0, False),
        ("busy", 3, 0.0, 5.0, True, 100.0, 100.0, 100, False), ("busy", 4, 90.0, None, None, None, None, None, None), ("busy", 5, 95.0, 200.0, True, 1.0, 1.0, 1, False),
        ("failed", 6, 80.0, 95.0, False, 500.0, 100.0, 0, False), ("limited", 7, 80.0, 85.0, True, 500.0, 100.0, 10, True), ("recovered", 8, 1.0, 20.0, False, 3000.0, 100.0, 0, False),
        ("later", 9, 500.0, 600.0, True, 1.0, 1.0, 1, False),
    ]
    got = {r.endpoint: r for r in routing.rank_endpoints(spark.createDataFrame(rows, call), 100.0, 6).collect()}
    assert "later" not in got and [e for e in sorted(got, key=lambda e: got[e].place)][-1] == "busy" and got["busy"].active == 2
    assert got["failed"].health == got["limited"].health == 1e9
    idle = got["idle"]
    latency = 0.8 * (0.8 * 1500 + 0.2 * 1000) + 0.2 * 2000
    ttft, tps = 0.8 * 800 + 0.2 * 400, 0.8 * 20 + 0.2 * 50
    assert abs(idle.latency_ms - latency) < 1e-6 and abs(idle.ttft_ms - ttft) < 1e-6 and abs(idle.tps - tps) < 1e-6
    assert abs(idle.health - (0.25 * ttft / 8000 + 0.15 * (1 - tps / 40))) < 1e-9
    assert abs(got["recovered"].health - (0.25 * (0.8 * 800 + 0.2 * 100) / 8000 + 0.15 * 0.5 + 0.15)) < 1e-9
    order = sorted((e for e in got if not got[e].active), key=lambda e: (got[e].latency_ms, got[e].health, e))
    assert [got[e].place for e in order] == list(range(1, len(order) + 1))
    assert routing.rank_endpoints(spark.createDataFrame(rows, call).limit(0), 100.0).collect() == []


def test_waits_see_the_state_of_the_moment(spark):
    n = spark.createDataFrame([(1, 1, [], 1000.0), (1, 2, [], 9000.0), (1, 3, [1, 2], 20000.0), (1, 4, [1], None)], "job_id long, node_id long, dep_ids array<long>, end_ms double")
    s = spark.createDataFrame([(1, 3, 4000.0), (1, 3, 12000.0), (1, 4, 1500.0), (1, 4, 3000.0), (1, 1, 50.0)], "job_id long, node_id long, at_ms double")
    got = sorted(map(tuple, hierarchy.wait_audit(n, s).collect()))
    assert got == [(1, 3, 1, 2, 2, 3000.0, hierarchy.BLOCKED, [2]), (1, 3, 2, 2, 2, 3000.0, hierarchy.QUEUED, []), (1, 4, 2, 2, 1, 2000.0, hierarchy.QUEUED, [])]


def test_quality_preferred_takes_later_models_when_calm(spark):
    nodes = spark.createDataFrame([(1, i, "chunk", "light", 0.1, 200.0, p) for i, p in enumerate((False, True, None))], "job_id long, node_id long, kind string, min_tier string, load double, intensity double, prefer_quality boolean")
    chain = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "place int, model string")
    live = spark.createDataFrame([("a", 800.0), ("b", 900.0), ("c", 1000.0)], "model string, rolling_ms double")
    got = {r.node_id: (r.model, r.utility) for r in routing.assign_models(nodes, chain, live).collect()}
    heavy = 0.40 * 0.92 - 0.30 * 1000 / 5000 - 0.25 * 0 - 0.25 * 0.1 + 0.06
    assert got[1] == ("c", round(heavy, 9)) and got[0] == got[2] and got[0][1] < got[1][1]


def test_evaluators(spark):
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat sat", "the cat sat down", 1), (2, "a b c", "x y", "a b c", 0), (3, "", "x", "", None)], "pair_id long, reference string, candidate string, context string, quality int")
    rows = {(r.evaluator, r.pair_id): (r.skipped, r.quality_score) for r in evaluators.evaluate(pairs, *evaluators.evaluator_names()).collect()}
    assert rows["lexical", 1] == (False, 100.0) and rows["lexical", 2] == (False, 0.0) and rows["lexical", 3][0] and rows["labelled", 3] == (True, None)
    assert rows["composite", 1][1] > 90 and rows["composite", 3][0] and {e for e, _ in rows} == {"composite", "labelled", "lexical"}
    assert {r.evaluator for r in evaluators.evaluate(pairs).collect()} == {evaluators.DEFAULT}
    with pytest.raises(KeyError, match="composite, labelled, lexical"):
        evaluators.evaluator("nobody")
    evaluators.register_evaluator("length", lambda p: p.select("pair_id", F.lit(False).alias("skipped"), F.length("candidate").alias("quality_score"), F.lit("").alias("note")))
    try:
        assert {r.quality_score for r in evaluators.evaluate(pairs, "length").collect()} == {11.0, 3.0, 1.0}
    finally:
        del evaluators._EVALUATORS["length"]


def test_table_function_is_the_operator(spark):
    e = graph_queries.edges(spark, "/root/testdata/sf0.001").filter("substr(src, 2) < '2' and substr(dst, 2) < '2'").select("src", "dst")
    ends = [r.v for r in e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().orderBy("v").limit(6).collect()]
    pairs = spark.createDataFrame([(a, b) for a in ends[:3] for b in [*ends[3:], "nowhere"]], "src string, dst string")
    register_table_functions(spark)
    e.selectExpr("'g' graph_id", "'edge' kind", "src", "dst").union(pairs.selectExpr("'g'", "'pair'", "src", "dst")).union(spark.sql("select 'h', 'pair', 'x', 'x'")).createOrReplaceTempView("links_of_test")
    got = {(r.graph_id, r.src, r.dst): (r.hops, r.path) for r in spark.sql("SELECT * FROM shortest_paths(TABLE(links_of_test) PARTITION BY graph_id)").collect()}
    want = {("g", r.src, r.dst): (r.hops, r.path) for r in cgraph.shortest_paths(e, pairs).collect()}
    assert got == want | {("h", "x", "x"): (0, "x")} and any(h for h, _ in want.values())


def docx(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


def test_uploads_from_files(spark, tmp_path):
    whole = docx("[Content_Types].xml", "word/document.xml")
    files = {
        "a.pdf": (b"%PDF-1.7\xff\x00", None), "b.pdf": (b" %PDF", "not_a_pdf"), "c.docx": (whole, None), "d.docx": (whole[:40], "not_a_docx"), "e.docx": (docx("[Content_Types].xml"), "not_a_docx"),
        "f.docx": (docx("word/x.xml"), "not_a_docx"), "g.txt": ("plain é".encode(), None), "h.txt": (b"x" * 8191 + b"\0", "binary_text"), "i.txt": (b"x" * 8192 + b"\0", None), "j.csv": (b"a,<SCRIPT src=1>", "markup_in_text"),
        "k.txt": (b"\xff\xfe<html>", "markup_in_text"), "l.txt": (b"y" * 4096 + b"<html>", None), "m.exe": (b"MZ", "unsupported_type"), "sub/o.PDF": (b"%PDF", None), "p": (b"z", "unsupported_type"),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.accepted, r.reason) for r in documents.validate_upload_bytes(documents.read_uploads(spark, str(tmp_path))).collect()}
    assert got == {n.rpartition("/")[2]: (why is None, why) for n, (_, why) in files.items()}
    odd = spark.createDataFrame([("a.txt", "Text/Plain; charset=x", bytearray(b"t")), ("b.txt", "image/png", bytearray(b"t")), ("c.txt", None, None)], "name string, content_type string, content binary")
    assert [(r.reason, r.stored_type) for r in documents.validate_upload_bytes(odd).orderBy("name").collect()] == [(None, "text/plain"), ("unsupported_content_type", None), ("empty", None)]
