"""How a module of queries lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name and their DuckDB SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        """Register a function of the tables under its own name."""

        def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return add


def collected() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of all modules of this package."""
    import importlib
    import pkgutil

    from corpusloom import plans

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        found = getattr(importlib.import_module(f"corpusloom.plans.{module}"), "query", None)
        if isinstance(found, Registry):
            queries |= found.queries
            sql |= found.sql
    return queries, sql
