"""Names of queries, the callables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Register f(spark, sf_dir) under its own name; sql is DuckDB SQL for the same rows."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep
