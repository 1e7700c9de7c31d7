"""The registry of named queries and their DuckDB check statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerwind.plans.oracle_views import statement
from ledgerwind.sources.tables import Lake

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(name: str, check: str | None = None) -> Callable[[Callable[[Lake], DataFrame]], Callable[[Lake], DataFrame]]:
    """Register a query over a :class:`Lake`, with its check statement if SQL can state it."""

    def keep(build: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Lake(spark, folder))
        if check is not None:
            CHECKS[name] = check
        return build

    return keep


def load() -> None:
    """Import every module that registers queries."""
    from ledgerwind.plans import (  # noqa: F401
        queries_alerts,
        queries_audit,
        queries_features,
        queries_forecast,
        queries_ingest,
        queries_monitor,
        queries_ratelimit,
        queries_reports,
        queries_retrieval,
        queries_store,
        queries_text,
    )


def check_statements() -> dict[str, str]:
    """The full DuckDB statement of every query that has one."""
    return {name: statement(check) for name, check in CHECKS.items()}
