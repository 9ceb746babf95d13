"""Every registered query beside SQL text that must give the same rows."""

from vulnlake.plans.catalog import (  # noqa: F401  (importing registers the queries)
    event_queries,
    export_queries,
    facet_queries,
    filter_queries,
    ingest_queries,
    overview_queries,
    page_queries,
    stream_queries,
    value_queries,
    version_queries,
)
from vulnlake.plans.catalog.registry import NOW, ORACLES, QUERIES

__all__ = ["NOW", "ORACLES", "QUERIES"]
