"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from .fixtures import with_fixtures

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, fixtures: str = "", sql: str = "", ctes: str = ""):
    """Registers a function of (spark, sf_dir); ``sql`` over the named fixtures is its counterpart."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_fixtures(fixtures, sql, ctes)
        return f

    return add
