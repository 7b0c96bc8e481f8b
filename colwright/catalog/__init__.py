"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from colwright.catalog import grouped, prepare, runs, scalars, scoring, series
from colwright.catalog.base import Query

_MODULES = (scalars, series, grouped, prepare, scoring, runs)


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in _MODULES:
        for name, query in module.book.queries.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = query
    return out


def all_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.book.sql.items()}
