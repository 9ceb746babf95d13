"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.operators import predicates, rows, versions
from vulnlake.plans.catalog.registry import NOW, SQL_NOW, on_current, query
from vulnlake.plans.relations import iso, over_findings
from vulnlake.sources.star_schema import findings_log
from vulnlake.spec import QuerySpec, resolve_time_range

EXPLORE_SQL = (
    '"findingId" AS id, cve, severity, cvss, status, "packageName", "packageVersion", "group", repo, '
    f'image, "kaiStatus", {iso("publishedAt")} AS "publishedAt"'
)

on_current("explore", f"SELECT {EXPLORE_SQL} FROM findings")(rows.project_explore)


def _flat_detail(detail: DataFrame) -> DataFrame:
    joined = {f: F.array_join(f, "|").alias(f) for f in fields.STRING_ARRAYS}
    return detail.select(*[joined.get(f, F.col(f)) for f in fields.DETAIL])


_DETAIL_SQL = (
    '"findingId" AS id, "group", repo, image, cve, severity, cvss, status, "packageName", "packageVersion", '
    "\"packageType\", path, \"advisoryType\", \"buildType\", type, description, '' AS cause, '' AS exploit, "
    "\"fixDate\", published, '' AS \"layerTime\", '' AS link, owner, '' AS \"vecStr\", \"kaiStatus\", "
    "array_to_string(\"riskFactors\", '|') AS \"riskFactors\", array_to_string(\"applicableRules\", '|') AS \"applicableRules\", "
    f'{iso("publishedAt")} AS "publishedAt", {iso("fixedAt")} AS "fixedAt", {iso("updatedAt")} AS "updatedAt"'
)

on_current("detail", f"SELECT {_DETAIL_SQL} FROM findings")(
    lambda current: _flat_detail(rows.project_detail(current))
)


@on_current(
    "detail_by_id",
    f'SELECT {_DETAIL_SQL} FROM findings WHERE "findingId" = (SELECT min("findingId") FROM findings)',
)
def _detail_by_id(current: DataFrame) -> DataFrame:
    known = current.agg(F.min("findingId").alias("id")).first().id
    return _flat_detail(rows.project_detail(predicates.by_id(current, known)))


def _scoped(name: str, spec: QuerySpec, where: str) -> None:
    """Register the page scope of a spec: the ids it keeps."""
    on_current(name, f'SELECT "findingId", severity, cvss FROM findings WHERE {where}')(
        lambda current: current.where(predicates.page_scope(spec)).select(
            "findingId", "severity", "cvss"
        )
    )


_scoped(
    "filter_in",
    QuerySpec(filters={"severity": ("high", "critical"), "advisoryType": ("F",)}),
    "severity IN ('high', 'critical') AND \"advisoryType\" = 'F'",
)
_scoped(
    "filter_blank_matches_null",
    QuerySpec(filters={"kaiStatus": ("", "reviewed")}),
    "coalesce(\"kaiStatus\", '') IN ('', 'reviewed')",
)
_scoped(
    "filter_risk_any",
    QuerySpec(filters={"riskFactors": ("Remote", "Has fix")}),
    "list_has_any(\"riskFactors\", ['Remote', 'Has fix'])",
)
COMBINED = QuerySpec(
    filters={"severity": ("critical", "high"), "riskFactors": ("reachable",)},
    mode="analysis",
    search="WIDGET",
    time_range=resolve_time_range("5y", NOW),
)
COMBINED_SQL = (
    "severity IN ('critical', 'high') AND list_has_any(\"riskFactors\", ['reachable']) "
    "AND (\"kaiStatus\" IS NULL OR \"kaiStatus\" <> 'invalid - norisk') "
    "AND (contains(lower(cve), 'widget') OR contains(lower(\"packageName\"), 'widget') "
    "OR contains(lower(image), 'widget') OR contains(lower(repo), 'widget')) "
    f"AND \"publishedAt\" BETWEEN {SQL_NOW} - INTERVAL 5 YEAR AND {SQL_NOW}"
)
_scoped("filter_combined", COMBINED, COMBINED_SQL)

on_current(
    "filter_except",
    "SELECT \"findingId\", severity FROM findings WHERE status = 'open' "
    "AND (\"kaiStatus\" IS NULL OR \"kaiStatus\" <> 'invalid - norisk')",
)(
    lambda current: current.where(
        predicates.facet_scope(
            QuerySpec(
                filters={"severity": ("high",), "status": ("open",)},
                mode="analysis",
                search="facets ignore it",
            ),
            skip="severity",
        )
    ).select("findingId", "severity")
)
_scoped("mode_all", QuerySpec(mode="all"), "true")
_scoped(
    "mode_analysis",
    QuerySpec(mode="analysis"),
    "\"kaiStatus\" IS NULL OR \"kaiStatus\" <> 'invalid - norisk'",
)
_scoped(
    "mode_ai",
    QuerySpec(mode="aiAnalysis"),
    "\"kaiStatus\" IS NULL OR \"kaiStatus\" <> 'ai-invalid-norisk'",
)
_scoped(
    "range_1y",
    QuerySpec(time_range=resolve_time_range("1y", NOW)),
    f"\"publishedAt\" BETWEEN {SQL_NOW} - INTERVAL 1 YEAR AND {SQL_NOW}",
)
_scoped(
    "range_custom_inclusive",
    QuerySpec(
        time_range=resolve_time_range(
            "custom", NOW, "1998-10-03T00:00:00Z", "1999-01-16T02:00:00+02:00"
        )
    ),
    "\"publishedAt\" BETWEEN TIMESTAMP '1998-10-03' AND TIMESTAMP '1999-01-16'",
)
_scoped(
    "search_any",
    QuerySpec(search="Small-R"),
    "contains(lower(cve), 'small-r') OR contains(lower(\"packageName\"), 'small-r') "
    "OR contains(lower(image), 'small-r') OR contains(lower(repo), 'small-r')",
)


@on_current(
    "search_literal_wildcards",
    "SELECT \"findingId\", name AS \"packageName\" FROM (SELECT \"findingId\", "
    "translate(\"packageName\", ' -', '%_') AS name FROM findings) WHERE contains(lower(name), '%w')",
)
def _search_literal_wildcards(current: DataFrame) -> DataFrame:
    """Signs of patterns in the searched values and in the search stand for themselves."""
    signs = current.withColumn("packageName", F.translate("packageName", " -", "%_"))
    found = signs.where(predicates.search_matches("%W"))
    return found.select("findingId", "packageName")

query(
    "filter_active",
    over_findings(
        'SELECT severity, count(*) AS "rows" FROM versions WHERE age = 1 AND NOT "isDeleted" GROUP BY ALL'
    ),
)(
    lambda spark, d: versions.newest_version(findings_log(spark, d))
    .where(predicates.active())
    .groupBy("severity")
    .agg(F.count("*").alias("rows"))
)
