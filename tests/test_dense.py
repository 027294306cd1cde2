"""Dense search against the plain join of all pairs of a scope."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.functions.text import cosine
from docflow.operators import retrieval


def joined(vectors, queries, k):
    met = vectors.join(queries, "scope").select("query_id", "chunk_id", cosine(F.col("q"), F.col("v")).alias("score"))
    return retrieval.top(met, k)


@pytest.mark.parametrize("cell, block", [(65_536, 4096), (3, 2)])
def test_dense_search_is_the_join(spark, monkeypatch, cell, block):
    monkeypatch.setattr(retrieval, "CELL", cell)
    monkeypatch.setattr(retrieval, "ASKED", block)
    draw, nan = random.Random(3), float("nan")
    some = [[draw.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(3)] for _ in range(6)]
    odd = [[0.0, 0.0, 0.0], [1.0, 2.0], [], None, [1.0, None, 2.0], [nan, 1.0, 1.0], [float("inf"), 1.0, 0.0], [1e-12, 0.0, 0.0]]
    pick = lambda: draw.choice(some) if draw.random() < 0.7 else draw.choice(odd)
    vectors = spark.createDataFrame([(f"c{i}", f"s{i % 2}", pick()) for i in range(60)], "chunk_id string, scope string, v array<float>")
    queries = spark.createDataFrame([(i, f"s{i % 3}", v) for i, v in enumerate(some + odd)], "query_id long, scope string, q array<double>")
    plain = lambda df: sorted((r.query_id, r.place, r.chunk_id, str(r.score)) for r in df.collect())
    for k in (1, 4, 40):
        assert plain(retrieval.dense_search(vectors, queries, k)) == plain(joined(vectors, queries, k))


def test_a_block_scores_few_pairs(monkeypatch):
    # All pairs go through one product of matrices; only near ones are scored for themselves.
    scored, sums = [], retrieval._sums
    monkeypatch.setattr(retrieval, "_sums", lambda a, b: (scored.append(len(a)), sums(a, b))[1])
    draw = np.random.default_rng(1)
    lists = lambda n: pa.array(list(draw.normal(size=(n, 8))), pa.list_(pa.float64()))
    v, q = pa.table({"chunk_id": list(range(3000)), "v": lists(3000)}), pa.table({"query_id": list(range(50)), "q": lists(50)})
    found = retrieval.nearest(v, q, 10)
    assert found.num_rows == 500 and sum(scored) <= 3000 + 50 + 500
