"""Facets: value counts per filter field, each ignoring its own filter."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.operators.predicates import common_scope, facet_scope, filter_matches
from vulnlake.operators.top import counts_of_lists, ranked, top_counts
from vulnlake.spec import QuerySpec

#: Values of a facet that the public contract shows; the functions take others.
FACET_SIZE = 200


def facet_value(field: str) -> Column:
    return F.coalesce(F.col(field), F.lit(""))


def facet(current: DataFrame, spec: QuerySpec, field: str, size: int = FACET_SIZE) -> DataFrame:
    """(value, count) of one facet."""
    scoped = current.where(facet_scope(spec, skip=field))
    if field in fields.STRING_ARRAYS:
        return top_counts(scoped.select(F.explode(field).alias("v")), F.col("v"), size)
    return top_counts(scoped, facet_value(field), size)


def facets_by_branch(current: DataFrame, spec: QuerySpec) -> DataFrame:
    """All facets as (facet, value, count), one branch per field."""
    branches = [
        facet(current, spec, f).select(F.lit(f).alias("facet"), "value", "count")
        for f in fields.FILTERABLE
    ]
    return reduce(DataFrame.unionByName, branches)


def facets(current: DataFrame, spec: QuerySpec, size: int = FACET_SIZE) -> DataFrame:
    """All facets as (facet, value, count) from one scan and one shuffle.

    A row counts for a facet when it passes every filter, or when the only
    filter it fails is the facet's own.
    """
    fails = {
        f: ~F.coalesce(filter_matches(f, values), F.lit(False))
        for f, values in spec.filters.items()
    }
    failures = reduce(add, [c.cast("int") for c in fails.values()], F.lit(0))

    def counts_for(field: str) -> Column:
        passes = failures == 0
        return passes | ((failures == 1) & fails[field]) if field in fails else passes

    scalars = {
        f: F.when(counts_for(f), facet_value(f))
        for f in fields.FILTERABLE
        if f not in fields.STRING_ARRAYS
    }
    (risks,) = (f for f in fields.FILTERABLE if f in fields.STRING_ARRAYS)
    elements = F.when(counts_for(risks), F.col(risks)).otherwise(F.array().cast("array<string>"))
    counts = counts_of_lists(
        current.where(common_scope(spec) & (failures <= 1)),
        scalars,
        (risks, elements),
        "facet",
        "value",
    )
    return ranked(counts, "facet", [F.desc("count"), F.asc("value")], size).select(
        "facet", "value", "count"
    )
