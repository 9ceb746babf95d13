"""The analyst's entry points over one set of current findings and events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from vulnlake.operators import compare as _compare
from vulnlake.operators import events as _events
from vulnlake.operators import facets as _facets
from vulnlake.operators import overview as _overview
from vulnlake.operators import paging as _paging
from vulnlake.operators import suggest as _suggest
from vulnlake.operators.export import ExportStore
from vulnlake.operators.predicates import by_id
from vulnlake.operators.rows import project_detail
from vulnlake.spec import QuerySpec


@dataclass(frozen=True)
class Findings:
    """Current findings of one dataset version, with its event log."""

    current: DataFrame
    events: DataFrame
    dataset_version: str

    def page(self, spec: QuerySpec) -> DataFrame:
        return _paging.page(self.current, spec)

    def fetch_page(self, spec: QuerySpec) -> _paging.Page:
        return _paging.fetch_page(self.current, spec)

    def total_count(self, spec: QuerySpec) -> DataFrame:
        return _paging.total_count(self.current, spec)

    def finding(self, id: str) -> DataFrame:
        return project_detail(by_id(self.current, id))

    def facets(self, spec: QuerySpec) -> DataFrame:
        return _facets.facets(self.current, spec)

    def suggest(self, prefix: str, limit: int | None = None) -> DataFrame:
        return _suggest.suggest(self.current, prefix, limit)

    def overview(self, spec: QuerySpec, as_of: datetime) -> DataFrame:
        return _overview.overview(self.current, spec, as_of)

    def compare(self, spec: QuerySpec, left: str, right: str) -> DataFrame:
        return _compare.compare_modes(self.current, spec, left, right)

    def dataset_info(self) -> DataFrame:
        return _events.dataset_info(self.current, self.events, self.dataset_version)

    def replay(self, last_id: str) -> DataFrame:
        return _events.replay_after(self.events, last_id)

    def export(self, store: ExportStore, spec: QuerySpec, now: datetime) -> dict:
        """Create and run one export job; returns its last manifest row."""
        return store.run(store.create(spec, now), self.current, now)
