"""Query registry: ``name -> (spark builder(spark, data_dir) -> DataFrame)``
and ``name -> oracle SQL``.  Modules register themselves on import."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: register a Spark query builder (and its oracle SQL)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco
