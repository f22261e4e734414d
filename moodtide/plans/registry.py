"""The register of queries and the SQL text that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``uses`` names the derived views its SQL reads, in order."""

    def add(function: Query) -> Query:
        _queries[name] = function
        if sql is not None:
            views = ",\n".join(f"{view} AS ({VIEWS[view]})" for view in uses)
            _sql[name] = f"WITH {views}\n{sql}" if views else sql
        return function

    return add


def all_queries() -> dict[str, Query]:
    from . import ingest, live, logs, models, reads, streams, textual  # noqa: F401  (they register on import)

    return dict(_queries)


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(_sql)
