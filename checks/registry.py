"""Checks by name: a Spark query and, where there is one, SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from checks.views import Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, views: str = ""):
    """Register a query; `views` names the views its SQL uses."""

    def register(query: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(tuple(views.split())) + sql
        return query

    return register
