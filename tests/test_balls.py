"""Paths by balls around both ends, components, and strongly connected components with edges both ways merged."""

import random
from collections import defaultdict

from docflow.operators import cgraph
from docflow.operators.tablefunctions import ShortestPaths


def counted(monkeypatch, name):
    """How often a step of cgraph runs from here on."""
    seen, plain = [], getattr(cgraph, name)
    monkeypatch.setattr(cgraph, name, lambda df: seen.append(name) or plain(df))
    return seen


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def test_paths_are_those_of_a_plain_search(spark):
    draw = random.Random(5)
    rows = [(f"a{draw.randrange(40)}", f"a{draw.randrange(40)}") for _ in range(55)] + [("b1", "b2"), ("b2", "b3")]
    pairs = [(f"a{draw.randrange(40)}", f"a{draw.randrange(40)}") for _ in range(30)] + [("a1", "b1"), ("b3", "b1"), ("none", "none"), ("a1", "none"), ("b1", "b1")]
    plain = ShortestPaths()
    for kind, part in (("edge", rows), ("pair", pairs)):
        for a, b in part:
            plain.eval({"graph_id": "g", "kind": kind, "src": a, "dst": b})
    want = {(a, b): (hops, path) for _, a, b, hops, path in plain.terminate()}
    e, asked = edges_of(spark, rows), edges_of(spark, [*pairs, (None, "a1")])
    got = {(r.src, r.dst): (r.hops, r.path) for r in cgraph.shortest_paths(e, asked).collect()}
    assert got == want | {(None, "a1"): (None, None)}
    near = {(r.src, r.dst): (r.hops, r.path) for r in cgraph.shortest_paths(e, asked, 3).collect()}
    assert near == {k: x if x[0] is not None and x[0] <= 3 else (None, None) for k, x in got.items()}


def test_ends_of_two_components_grow_no_balls(spark, monkeypatch):
    line = lambda name: [(f"{name}{i}", f"{name}{i + 1}") for i in range(40)]
    cuts = counted(monkeypatch, "cut")
    e = edges_of(spark, line("a") + line("b"))
    assert [r.hops for r in cgraph.shortest_paths(e, edges_of(spark, [("a0", "b0")])).collect()] == [None]
    assert len(cuts) < 10


def test_two_way_chains_take_few_rounds(spark, monkeypatch):
    chain = [(f"s{i}", f"s{i + d}") for i in range(120) for d in (1, -1)]
    ring = [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r2", "s5"), ("t0", "t1"), ("t1", "t0"), ("t1", "t2"), ("t2", "t3"), ("t3", "t0")]
    cuts = counted(monkeypatch, "cut")
    got = defaultdict(set)
    for r in cgraph.scc(edges_of(spark, chain + ring)).collect():
        got[r.component].add(r.id)
    assert dict(got) == {"r0": {"r0", "r1", "r2"}, "s0": {f"s{i}" for i in range(120)}, "t0": {"t0", "t1", "t2", "t3"}}
    assert len(cuts) < 100, len(cuts)
