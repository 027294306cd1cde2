"""Tasks of the BM25 search: postings of one scope and of one common word do not meet in one task."""

from docflow.operators import retrieval
from docflow.operators.evaluation import freeze_retrieval


def test_postings_of_one_scope_stay_in_many_tasks(spark, monkeypatch):
    files = {}

    def spied(df, written=getattr(retrieval, "written", None)):
        out = written(df)
        files["impact" if "impact" in out.columns else str(out.columns)] = len(out.inputFiles())
        return out

    monkeypatch.setattr(retrieval, "written", spied, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = spark.createDataFrame([("all", i, f"common w{i % 9}") for i in range(400)], "scope string, chunk_id long, text string")
        asked = spark.createDataFrame([(1, "all", "common w3"), (2, "all", "common nowhere")], "query_id long, scope string, query string")
        got = retrieval.bm25_search(chunks, asked, 3).collect()
        plan = retrieval.bm25_search(chunks, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.query_id, r.chunk_id, r.place) for r in got) == [(1, 3, 1), (1, 12, 2), (1, 21, 3), (2, 0, 1), (2, 1, 2), (2, 2, 3)]
    assert files.get("impact", 0) > 4
    assert "broadcast" in plan


def test_equal_passages_stay_by_rank(spark):
    """A difference of rounding between the scores of two equal passages does not decide which one is kept."""
    hits = spark.createDataFrame([(1, "a", 2.0, 1), (1, "b", 2.0 + 1e-13, 2)], "query_id long, chunk_id string, score double, place int")
    chunks = spark.createDataFrame([(c, "the same words in both", f"p{c}", "s") for c in "ab"], "chunk_id string, content string, parent_id string, section_path string")
    assert [r.chunk_ids for r in freeze_retrieval(hits, chunks).collect()] == ["a"]
