"""All queries over the driver's tables, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from tessera.sources.adapters import with_relations

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL if there is one."""

    def wrap(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_relations(sql, *uses)
        return f

    return wrap


def load() -> None:
    """Import the modules that register queries."""
    from tessera.plans import claims, evaluation, graph, jobs, readpath, retrieval, text, turns  # noqa: F401
