"""Registry of queries and of SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from vulnlake.plans.relations import over_events, over_findings
from vulnlake.sources import star_events
from vulnlake.sources.star_schema import current_findings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = datetime(2001, 12, 1, tzinfo=timezone.utc)
SQL_NOW = "TIMESTAMP '2001-12-01 00:00:00'"
NOW_MS = int(NOW.timestamp() * 1000)
BURST = "9 hours"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def on_current(name: str, select: str, more: str = "") -> Callable:
    """Register a query that reads current findings."""

    def register(function: Callable[[DataFrame], DataFrame]) -> Callable:
        query(name, over_findings(select, more))(
            lambda spark, sf_dir: function(current_findings(spark, sf_dir))
        )
        return function

    return register


def on_events(name: str, select: str, more: str = "") -> Callable:
    """Register a query that reads change events."""

    def register(function: Callable[[DataFrame], DataFrame]) -> Callable:
        query(name, over_events(select, more))(
            lambda spark, sf_dir: function(star_events.events_of(spark, sf_dir))
        )
        return function

    return register
