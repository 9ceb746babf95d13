"""Filters over current findings, each one a plain Column."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.spec import QuerySpec, TimeRange, finding_id


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def filter_matches(field: str, values: tuple[str, ...]) -> Column:
    """Row has one of the values; NULL counts as ''."""
    if field in fields.STRING_ARRAYS:
        wanted = F.array(*[F.lit(v) for v in values])
        return F.coalesce(F.arrays_overlap(F.col(field), wanted), F.lit(False))
    listed = F.col(field).isin(*values)
    return (listed | F.col(field).isNull()) if "" in values else listed


def filters_match(filters: dict[str, tuple[str, ...]], skip: str | None = None) -> list[Column]:
    return [filter_matches(f, v) for f, v in filters.items() if f != skip]


def mode_matches(mode: str) -> Column:
    """Exact exclusion of one kaiStatus; rows without one always stay."""
    excluded = fields.ANALYSIS_EXCLUSIONS[mode]
    if excluded is None:
        return F.lit(True)
    return F.col("kaiStatus").isNull() | (F.col("kaiStatus") != excluded)


def in_time_range(bounds: TimeRange) -> list[Column]:
    """Inclusive publishedAt bounds; undated rows drop out once a bound exists."""
    conditions = []
    if bounds.start is not None:
        conditions.append(F.col("publishedAt") >= F.lit(bounds.start))
    if bounds.end is not None:
        conditions.append(F.col("publishedAt") <= F.lit(bounds.end))
    return conditions


def search_matches(text: str) -> Column:
    """Case-insensitive literal substring of any searchable column."""
    needle = F.lower(F.lit(text))
    return reduce(or_, [F.contains(F.lower(F.col(c)), needle) for c in fields.SEARCHABLE])


def prefix_matches(field: str, prefix: str) -> Column:
    """Non-blank value that starts with the prefix, ignoring case."""
    column = F.col(field)
    return (column != "") & F.startswith(F.lower(column), F.lower(F.lit(prefix)))


def active() -> Column:
    return ~F.col("isDeleted")


def common_scope(spec: QuerySpec) -> Column:
    """Conditions shared by every facet: mode and time, without field filters."""
    conditions = in_time_range(spec.time_range)
    if spec.mode != "all":
        conditions.append(mode_matches(spec.mode))
    return all_of(conditions)


def page_scope(spec: QuerySpec, skip: str | None = None) -> Column:
    """Full scope of pages, counts and exports."""
    conditions = [common_scope(spec), *filters_match(spec.filters, skip)]
    if spec.search is not None:
        conditions.append(search_matches(spec.search))
    return all_of(conditions)


def facet_scope(spec: QuerySpec, skip: str | None = None) -> Column:
    """Scope of facets, which ignore the search text."""
    return all_of([common_scope(spec), *filters_match(spec.filters, skip)])


def overview_scope(spec: QuerySpec) -> Column:
    """Scope of the overview, which ignores search text and analysis mode."""
    return all_of([*in_time_range(spec.time_range), *filters_match(spec.filters)])


def by_id(current: DataFrame, id: str) -> DataFrame:
    """At most one row: the finding with this id."""
    return current.where(F.col("findingId") == finding_id(id)).limit(1)
