"""Facets, suggestions and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.operators import compare, facets, suggest
from vulnlake.plans.catalog.overview_queries import rank_sql, top_sql
from vulnlake.plans.catalog.registry import on_current
from vulnlake.spec import QuerySpec

_FACET_SPEC = QuerySpec(
    filters={"severity": ("critical", "high"), "kaiStatus": ("", "reviewed"),
             "riskFactors": ("reachable", "Remote")},
    mode="aiAnalysis",
    search="ignored by facets",
)
_FACET_FILTERS = {
    "severity": "severity IN ('critical', 'high')",
    "kaiStatus": "coalesce(\"kaiStatus\", '') IN ('', 'reviewed')",
    "riskFactors": "list_has_any(\"riskFactors\", ['reachable', 'Remote'])",
}
_FACET_MODE = "(\"kaiStatus\" IS NULL OR \"kaiStatus\" <> 'ai-invalid-norisk')"


def _facet_sql(field: str) -> str:
    where = " AND ".join([_FACET_MODE, *[s for f, s in _FACET_FILTERS.items() if f != field]])
    if field == "riskFactors":
        return top_sql(
            "value", 200, f'(SELECT unnest("riskFactors") AS value FROM findings WHERE {where})'
        )
    return top_sql(f"coalesce(\"{field}\", '')", 200, f"(SELECT * FROM findings WHERE {where})")


_FACET_KEYS = {
    "severity": "facet_severity",
    "status": "facet_status",
    "group": "facet_group",
    "repo": "facet_repo",
    "image": "facet_image",
    "packageType": "facet_package_type",
    "advisoryType": "facet_advisory_type",
    "kaiStatus": "facet_kai_status",
    "riskFactors": "facet_risk_factors",
}
for _field, _key in _FACET_KEYS.items():
    on_current(_key, _facet_sql(_field))(
        lambda current, field=_field: facets.facet(current, _FACET_SPEC, field)
    )

_ALL_FACETS = " UNION ALL ".join(
    f"SELECT '{f}' AS facet, * FROM ({_facet_sql(f)})" for f in fields.FILTERABLE
)
on_current("facets_one_pass", _ALL_FACETS)(lambda current: facets.facets(current, _FACET_SPEC))
on_current("facets_by_branch", _ALL_FACETS)(
    lambda current: facets.facets_by_branch(current, _FACET_SPEC)
)

_CANDIDATES = "candidates AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, value, row_number() OVER (ORDER BY strlen(value), value) AS place FROM "
    f"(SELECT DISTINCT \"{f}\" AS value FROM findings WHERE \"{f}\" <> '' AND starts_with(lower(\"{f}\"), 'r'))"
    for f in fields.SEARCHABLE
) + ")"

on_current("suggest_candidates", "SELECT * FROM candidates WHERE place <= 10", _CANDIDATES)(
    lambda current: suggest.suggest_candidates(current, "R").withColumn(
        "place", F.col("place").cast("long")
    )
)
on_current(
    "suggest",
    "SELECT ord, CASE field WHEN 'cve' THEN 'CVE' WHEN 'packageName' THEN 'PACKAGE_NAME' "
    "WHEN 'image' THEN 'IMAGE' ELSE 'REPO' END AS field, value FROM (SELECT *, row_number() OVER (ORDER BY "
    "place > 2, list_position(['cve', 'packageName', 'image', 'repo'], field), place) AS ord "
    "FROM candidates WHERE place <= 10) WHERE ord <= 10",
    _CANDIDATES,
)(lambda current: suggest.suggest(current, "R"))
on_current(
    "distinct_values",
    "SELECT DISTINCT image AS value FROM findings WHERE starts_with(lower(image), 'registry')",
)(lambda current: suggest.distinct_values(current, "image", "Registry"))

_COMPARE_SPEC = QuerySpec(filters={"severity": ("critical", "high", "low"), "status": ("open",)})
LEFT_SQL = "(\"kaiStatus\" IS NULL OR \"kaiStatus\" <> 'invalid - norisk')"
RIGHT_SQL = "(\"kaiStatus\" IS NULL OR \"kaiStatus\" <> 'ai-invalid-norisk')"


def _compare_sql(metric: str, value: str, where: str, rank: str) -> str:
    return (
        f"SELECT '{metric}' AS metric, {rank} AS rank, key, CASE WHEN key = '' THEN '(blank)' ELSE key END AS label, "
        f'l AS "left", r AS "right", r - l AS delta FROM (SELECT {value} AS key, count(*) FILTER ({LEFT_SQL}) AS l, '
        f"count(*) FILTER ({RIGHT_SQL}) AS r FROM findings WHERE {where} GROUP BY 1) WHERE l > 0 OR r > 0"
    )


_OPEN = "status = 'open'"
_LISTED = "severity IN ('critical', 'high', 'low')"
on_current(
    "compare_modes",
    " UNION ALL ".join(
        [
            _compare_sql("total", "'total'", f"{_OPEN} AND {_LISTED}", "1"),
            _compare_sql(
                "severity", "severity", _OPEN, rank_sql("key", compare.SEVERITY_ORDER)
            ),
            _compare_sql("kaiStatus", "coalesce(\"kaiStatus\", '')", f"{_OPEN} AND {_LISTED}", "1"),
        ]
    ),
)(lambda current: compare.compare_modes(current, _COMPARE_SPEC, "analysis", "aiAnalysis"))


@on_current(
    "compare_merge",
    f'SELECT {rank_sql("key", compare.SEVERITY_ORDER)} AS rank, key, key AS label, l AS "left", r AS "right", r - l AS delta '
    f"FROM (SELECT severity AS key, count(*) FILTER ({LEFT_SQL}) AS l, count(*) FILTER ({RIGHT_SQL}) AS r FROM findings GROUP BY 1)",
)
def _compare_merge(current: DataFrame) -> DataFrame:
    left, right = (
        facets.facet(current, QuerySpec(mode=m), "severity") for m in ("analysis", "aiAnalysis")
    )
    return compare.compare_merge(left, right, compare.SEVERITY_ORDER)
