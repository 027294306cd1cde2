"""Features of chunks: what earlier chunks of a document held, and one shuffle for all of it."""

import re

from docflow.operators import features

CHUNK = "doc_id long, chunk_index int, content string, kind string, section_path string"


def test_novelty_counts_words_that_no_earlier_chunk_has(spark):
    texts = {1: ["alpha beta", "Beta gamma", None, "12 a", "alpha gamma"], 2: ["gamma", "delta gamma delta"], None: ["alpha one"]}
    rows = [(d, i, t, "Text", "") for d, ts in texts.items() for i, t in reversed(list(enumerate(ts)))]
    want = {}
    for d, ts in texts.items():
        seen = set()
        for i, t in enumerate(ts):
            own = set(re.findall("[a-z]{3,}", (t or "").lower()))
            want[d, i] = len(own - seen) / len(own) if own else 0.0
            seen |= own
    got = features.novelty(spark.createDataFrame(rows, CHUNK).repartition(3)).collect()
    assert {(r.doc_id, r.chunk_index): r.novelty for r in got} == want


def test_chunk_features_take_one_shuffle_without_texts(spark):
    rows = [(d, i, f"word{d} $x = {i}$ shall", "Text", "") for d in range(3) for i in range(4)]
    out = features.chunk_features(spark.createDataFrame(rows, CHUNK))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Aggregate") == 0 and plan.count("RepartitionByExpression") == 1
    assert out.count() == 12 and {r.equation_count for r in out.collect()} == {1} and {r.section_type for r in out.collect()} == {"equation_heavy"}
