"""Registry of the named queries and of the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    """Adds a query; ``oracle`` is DuckDB SQL that returns the same rows, if there is one."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def load_all() -> None:
    """Imports the modules that register queries."""
    from vectorloom.plans import data, evaluation, losses, mixes, retrieval, sources  # noqa: F401
