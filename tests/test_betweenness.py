"""Betweenness by blocks of vertices and batches of sources against a plain search (Brandes)."""

import random
from collections import Counter, defaultdict, deque

import pytest

from docflow.operators import cgraph


def plain(edges, sources):
    step = defaultdict(set)
    for a, b in edges:
        if a != b:
            step[a].add(b)
            step[b].add(a)
    total = Counter()
    for s in sources:
        dist, paths, order, todo = {s: 0}, Counter({s: 1}), [], deque([s])
        while todo:
            x = todo.popleft()
            order.append(x)
            for y in step[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    todo.append(y)
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
        share = Counter()
        for x in reversed(order[1:]):
            for y in step[x]:
                if dist[y] == dist[x] - 1:
                    share[y] += paths[y] / paths[x] * (1 + share[x])
            total[x] += share[x]
    return dict(total)


def test_blocks_and_batches_change_nothing(spark, monkeypatch):
    """Small blocks, few sources a batch, two components, a long tail, repeated edges and loops."""
    monkeypatch.setattr(cgraph, "BLOCK", 7)
    monkeypatch.setattr(cgraph, "MOST_SOURCES", 20)
    draw = random.Random(5)
    edges = [(f"v{draw.randrange(40)}", f"v{draw.randrange(40)}") for _ in range(70)] + [(f"v{i}", f"v{i + 1}") for i in range(39, 48)]
    edges += edges[:10] + [("w", "x"), ("x", "y"), ("w", "w")]
    names = {x for e in edges for x in e}
    got = {r.id: r.betweenness for r in cgraph.betweenness(spark.createDataFrame(edges, "src string, dst string"), len(names)).collect()}
    assert got == pytest.approx(plain(edges, names))


def test_rounds_move_a_row_a_vertex_and_block(spark, monkeypatch):
    """All sources of a vertex travel together: rows of a round do not grow with the sources."""
    most, written = [], cgraph.written
    monkeypatch.setattr(cgraph, "written", lambda df: [out := written(df), most.append(out.count())][0])
    monkeypatch.setattr(cgraph, "cut", lambda df, cut=cgraph.cut: [out := cut(df), most.append(out.count())][0])
    edges = [(f"a{i}", f"b{j}") for i in range(50) for j in range(20)]
    cgraph.betweenness(spark.createDataFrame(edges, "src string, dst string"), 70).count()
    assert max(most) <= 2 * len(edges)


def test_no_edges(spark):
    assert cgraph.betweenness(spark.createDataFrame([("a", "a")], "src string, dst string"), 3).count() == 0
