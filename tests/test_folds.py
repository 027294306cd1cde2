"""Headings, chunking, merging and packing: truth tables and what must hold of every result."""

import pytest

from docflow.operators import folds, headings, kgraph


HEADINGS = [
    ("1. PROBLEM STATEMENT AND SCOPE", True), ("1.1 Problem Statement", True), ("Introduction", True), ("CHAPTER 2. DESIGN OF THE SYSTEM", True),
    ("Alice Johnson", False), ("Date: December 2025", False), ("Team Members:", False), ("1. Carbon-Aware Model Routing", False), ("see https://x.org", False), ("it was a long day and we were all very tired", False),
]


def test_heading_truth_table(spark):
    rows = [("d", 2 * i + 1, t, "Text", 0) for i, (t, _) in enumerate(HEADINGS)] + [("d", 2 * i, f"some plain body text of the document number {i} that goes on and on", "Text", 0) for i in range(len(HEADINGS) + 1)]
    got = {r.text: r for r in headings.score_headings(spark.createDataFrame(rows, "doc_id string, index int, text string, block_type string, page int")).collect()}
    assert {t: got[t].accepted for t, _ in HEADINGS} == dict(HEADINGS)
    assert got["1.1 Problem Statement"].level >= 2 and got["Alice Johnson"].classification == "person_name"


def elements(spark, rows):
    return spark.createDataFrame([("d", i, k, t) for i, (k, t) in enumerate(rows)], "doc_id string, pos int, type string, content string")


def test_tables_stay_whole_and_titles_open_parents(spark):
    e = elements(spark, [("Title", "Introduction"), ("Text", "first words"), ("Table", "a | b"), ("Title", "Methods"), ("Text", "second words"), ("Text", " ")])
    out = folds.adaptive_chunks(e).orderBy("chunk_index").collect()
    assert [(r.kind, r.title, r.content) for r in out] == [("Text", "Introduction", "Introduction\n\nfirst words"), ("Table", "Introduction", "a | b"), ("Text", "Methods", "Methods\n\nsecond words")]
    assert [r.reason for r in out] == ["table_boundary", "table_boundary", "end_of_document"]


def test_long_texts_split_with_an_overlap(spark):
    texts = [f"word{i} " * 100 for i in range(8)]
    out = folds.adaptive_chunks(elements(spark, [("Text", t) for t in texts]), most=400, least=10_000, overlap=5).orderBy("chunk_index").collect()
    assert len(out) > 2 and all(r.tokens <= 430 for r in out) and out[0].reason == "max_token_threshold"
    assert out[1].content.startswith(out[0].content[-20:])


def test_packs_end_under_the_cap_or_whole(spark):
    c = spark.createDataFrame([("d", i, "Table" if i == 4 else "Text", 0, "x" * 40) for i in range(12)], "doc_id string, chunk_index int, kind string, parent int, content string")
    out = folds.consolidate(c, cap=5, most=64).collect()
    assert len(out) <= 5 and sum(r.merged for r in out) == 12 and sum(r.kind == "Table" for r in out) == 1


def test_what_folds_give_leaves_before_all_documents_are_folded(spark):
    def fold(items):
        class Text(str):
            def __del__(self):
                alive[0] -= 1

        alive[0] += 1
        yield Text(items[0]["content"] * 8000), alive[0]

    alive = [0]
    rows = spark.range(4000).selectExpr("id as doc_id", "0 as pos", "'x' as content")
    out = folds.fold_documents(rows, "pos", ["content"], fold, "text string, alive int").selectExpr("count(*) as n", "sum(length(text)) as size", "max(alive) as most").first()
    assert (out.n, out.size) == (4000, 4000 * 8000) and out.most < 200


@pytest.mark.parametrize("kind", ["string", "bigint", "decimal(9,0)", "date"])
def test_documents_of_any_type_of_id_fold_in_order(spark, kind):
    key = {"string": "'d'", "bigint": "7L", "decimal(9,0)": "cast(7 as decimal(9,0))", "date": "date'2024-01-02'"}[kind]
    rows = spark.range(300).selectExpr(f"if(id % 3 = 0, null, {key}) as doc_id", "int(299 - id) as pos", "string(id) as content")
    out = folds.fold_documents(rows, "pos", ["content"], lambda items: iter([(" ".join(x["content"] for x in items), len(items))]), "text string, n int").collect()
    want = sorted(" ".join(str(i) for i in range(299, -1, -1) if (i % 3 == 0) == null) for null in (True, False))
    assert sorted(r.text for r in out) == want and sorted(r.n for r in out) == [100, 200]


SECTION = "doc_id string, section long, heading string, level int, body string"


def test_alike_neighbours_merge_and_hard_headings_do_not(spark):
    body = "carbon aware routing of language models saves energy in every data center " * 3
    rows = [("d", 0, "One", 2, body), ("d", 1, "Two", 2, body), ("d", 2, "References", 1, body), ("e", 0, "A", 2, "alpha beta gamma"), ("e", 1, "B", 2, "delta epsilon zeta")]
    got = sorted((r.doc_id, r.section, r.parts) for r in folds.merge_sections(spark.createDataFrame(rows, SECTION)).collect())
    assert got == [("d", 0, 2), ("d", 2, 1), ("e", 0, 1), ("e", 1, 1)]


@pytest.mark.parametrize("sizes", [[100] * 20, [3000, 10, 10], [900, 100, 1300, 50], [5]])
def test_packed_chunks_keep_all_words(spark, sizes):
    rows = [("d", i, f"H{i}", 2, "\n\n".join(["word " * 40] * max(1, n // 50))) for i, n in enumerate(sizes)]
    out = folds.pack_sections(spark.createDataFrame(rows, SECTION)).collect()
    assert sum(r.content.count("word") for r in out) == sum(r[4].count("word") for r in rows) and all(r.tokens <= 1210 for r in out)


def test_regions_stay_within_their_budget(spark):
    rows = [("d", i, str(i // 4), "text of summary " * 20) for i in range(30)]
    out = folds.regional_groups(spark.createDataFrame(rows, "doc_id string, chunk_index int, section string, summary string"), budget=300).collect()
    by = {}
    for r in out:
        by[r.region] = by.get(r.region, 0) + r.tokens
    assert len(out) == 30 and max(by.values()) <= 300


def test_junk_answers_give_no_knowledge(spark):
    raw = spark.createDataFrame([("d", 0, "no json"), ("d", 1, '```json\n{"entities": [{"id": "e1", "name": "Acme", "evidence": [{"chunk_id": "c1", "quote": "Acme"}]},],}\n```')], "doc_id string, batch int, raw string")
    items, rel = kgraph.knowledge_tables(raw)
    assert [r.node_id for r in items.collect()] == ["e1"] and rel.count() == 0


def test_answers_are_parsed_once(spark):
    """Mending and parsing stand once in the plan; nulls among the items keep their rows."""
    raw = spark.createDataFrame([("d", 0, '{"entities": [null, {"id": "e"}], "concepts": [{"id": "c", "label": "l"}], "relations": [{"src": "a"}, null]}')], "doc_id string, batch int, raw string")
    items, rel = kgraph.knowledge_tables(raw)
    for df in (items, rel):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and plan.count("(?i)```") == 2
    assert sorted((r.node_id or "", r.type, r.name) for r in items.collect()) == [("", "Entity", None), ("c", "Concept", "l"), ("e", "Entity", None)]
    assert [r.src for r in rel.collect()] == ["a", None]
