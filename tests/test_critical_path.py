"""Critical paths: small jobs take one pass without rounds, large ones rounds; both say the same."""

from docflow.operators import hierarchy

NODE, EDGE = "job_id long, node_id int, latency_ms double", "job_id long, node_id int, dep int"


def test_small_jobs_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "cut", lambda df: 1 / 0)
    n = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (1, 3, None), (1, 4, 9.0), (2, 1, -3.0), (3, 1, 1.0), (3, 2, 2.0), (None, 1, 4.0), (None, 2, 6.0)], NODE)
    e = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 3, 3), (1, 4, 7), (3, 1, 2), (3, 2, 1), (4, 1, 2), (None, 2, 1)], EDGE)
    assert {r.job_id: r.critical_ms for r in hierarchy.critical_path(n, e).collect()} == {1: 9.0, 2: -3.0, 3: 3.0, None: 6.0}


def test_large_jobs_agree_with_small_ones(spark):
    n = spark.range(60).selectExpr("id % 5 as job_id", "int(id div 5) as node_id", "double(id * 7 % 11) as latency_ms")
    e = n.selectExpr("job_id", "node_id", "explode(array(node_id - 1, node_id - 3)) as dep").filter("dep >= 0 and (job_id + dep) % 4 > 0")
    wide = spark.range(600).selectExpr("9L as job_id", "int(id) as node_id", "double(id) as latency_ms")
    n, e = n.union(wide), e.union(wide.filter("node_id > 0").selectExpr("job_id", "node_id", "0 as dep"))
    got = sorted(hierarchy.critical_path(n, e).collect())
    assert got == sorted(hierarchy._by_rounds(n, e).collect()) and len(got) == 6 and got[-1].critical_ms == 599.0
