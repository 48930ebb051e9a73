"""Every query by name, with its SQL twin where one exists.

A query is written with the DataFrame API; its twin is SQL for another engine, so that the
two are written apart. ``register`` is the one place where both are named.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from factlode.sources.fixtures import with_fixtures

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
MODULES = ("facts", "formulas", "market", "ops", "corpus", "search", "language", "fusion", "retrieval", "reports", "tables", "grounding", "semantic", "names", "files", "charts", "measures", "assessments")


def register(name: str, query: Callable, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"two queries are named {name}")
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = with_fixtures(sql)


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        register(name, f, sql)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"factlode.operators.{m}")
    importlib.import_module("factlode.streaming.requests")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
