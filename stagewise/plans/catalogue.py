"""All queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

from . import learn_queries, store_queries

_MODULES = [store_queries, learn_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
