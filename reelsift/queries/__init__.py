"""Registry of named queries: name -> (spark callable, DuckDB oracle SQL or None).

Every query reads the driver tables at ``sf_dir`` through ``reelsift.adapt`` and runs over
the whole tables; the oracle SQL re-derives the same domain tables with the CTEs in
``reelsift.queries.sql``.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "forecast_features"


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    from reelsift.queries import (features, quality, explore, splits, reconcile, ml,  # noqa: F401
                                  streams, io)


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(SQL)
