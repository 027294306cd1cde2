"""Queries of the event log against their SQL where times are zero, unknown, negative or tip a rounding."""

import duckdb
import pytest

from docflow.plans.catalog import ORACLES, QUERIES

# The last run's stages add up to 102.4, or a bit less from the slowest down; their shares lie halfway between two roundings.
VALUES = [0.0, None, -2.5, 0.01, 20.48, 3.3, 0.0, 0.0, 52.68, 30.36, 19.36]
STAGES = ["click", "view", "error", "signup", "purchase", "click", "error", "click", "error", "signup", "click"]


@pytest.mark.parametrize("name", ["tel2_rank_bottlenecks", "tel10_generation_timing", "tel11_eta"])
def test_query_matches_its_sql_on_odd_times(spark, tmp_path, name):
    # user_id x 100 + event_id % 10 names a run: zeros make up run 1, the last three rows run 2.
    users = [0, 0, 0, 0, 0, 0, 1, 1, 2, 2, 2]
    ids = [10, 20, 30, 41, 53, 60, 70, 80, 90, 100, 110]
    rows = ", ".join(f"({i}, {u}, '{s}', {'NULL' if v is None else v}::DOUBLE)" for i, u, s, v in zip(ids, users, STAGES, VALUES))
    db = duckdb.connect()
    db.execute(f"COPY (SELECT * FROM (VALUES {rows}) AS t(event_id, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = db.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    plain = lambda r: tuple(str(v + 0.0) if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(plain, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(map(plain, got.fetchall()))
