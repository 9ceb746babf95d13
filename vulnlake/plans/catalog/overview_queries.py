"""Overview totals and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.operators import overview
from vulnlake.plans.catalog.registry import NOW, SQL_NOW, on_current
from vulnlake.spec import QuerySpec

_SCOPE = QuerySpec(filters={"advisoryType": ("F", "O")})
_SCOPED = "scoped AS (SELECT * FROM findings WHERE \"advisoryType\" IN ('F', 'O'))"
_FIXED = "lower(status) LIKE 'fixed%'"
_CORE_SQL = f"""
SELECT count(*) AS total, count(DISTINCT cve) AS "uniqueCves",
  count(*) FILTER ("kaiStatus" IS NULL OR "kaiStatus" <> 'invalid - norisk') AS "analysisCount",
  count(*) FILTER ("kaiStatus" IS NULL OR "kaiStatus" <> 'ai-invalid-norisk') AS "aiAnalysisCount",
  round(coalesce(avg(cvss), 0), 6) AS "averageCvss", count(*) FILTER ({_FIXED}) AS "fixedStatus",
  count(*) FILTER (list_contains("riskFactors", 'Has fix')) AS "fixAvailable",
  count(DISTINCT cve) FILTER ({_FIXED}) AS "fixedCves" FROM scoped
"""
_AGE_SQL = f"""CASE WHEN "publishedAt" IS NULL THEN 'unknown'
  WHEN "publishedAt" >= {SQL_NOW} - INTERVAL 30 DAY THEN '0-30d'
  WHEN "publishedAt" >= {SQL_NOW} - INTERVAL 90 DAY THEN '31-90d'
  WHEN "publishedAt" >= {SQL_NOW} - INTERVAL 1 YEAR THEN '91-365d'
  WHEN "publishedAt" >= {SQL_NOW} - INTERVAL 5 YEAR THEN '1-5y' ELSE '5y+' END"""
_FIX_SQL = """CASE WHEN "fixedAt" IS NULL OR "publishedAt" IS NULL OR "fixedAt" <= "publishedAt" THEN 'unresolved'
  WHEN date_diff('day', "publishedAt", "fixedAt") < 7 THEN '0-6d'
  WHEN date_diff('day', "publishedAt", "fixedAt") < 30 THEN '7-29d'
  WHEN date_diff('day', "publishedAt", "fixedAt") < 90 THEN '30-89d'
  WHEN date_diff('day', "publishedAt", "fixedAt") < 365 THEN '90-364d' ELSE '1y+' END"""


def rank_sql(key: str, order: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{k}'" for k in order)
    return f"CAST(list_position([{listed}], {key}) AS BIGINT)"


def top_sql(value: str, k: int, source: str = "scoped") -> str:
    return (
        f'SELECT {value} AS value, count(*) AS "count" FROM {source} GROUP BY 1 '
        f'ORDER BY 2 DESC, 1 LIMIT {k}'
    )


def _rounded_core(core: DataFrame) -> DataFrame:
    return core.withColumn("averageCvss", F.round("averageCvss", 6))


on_current("overview_core", _CORE_SQL, _SCOPED)(
    lambda current: _rounded_core(overview.overview_core(current, _SCOPE))
)

_DIMENSION_SQL = {
    **{m: top_sql(f'"{c}"', 20) for m, c in overview.DIMENSIONS.items()},
    overview.RISK_DIMENSION: top_sql(
        "value", 20, '(SELECT unnest("riskFactors") AS value FROM scoped)'
    ),
}
_DIMENSION_KEYS = {
    "severityDistribution": "top_severity",
    "byRepository": "top_repo",
    "byImage": "top_image",
    "topPackages": "top_package",
    "riskFactorDistribution": "overview_risk",
}
for _metric, _key in _DIMENSION_KEYS.items():
    on_current(_key, _DIMENSION_SQL[_metric], _SCOPED)(
        lambda current, metric=_metric: overview.top_dimension(current, _SCOPE, metric)
    )

on_current(
    "overview_age",
    f'SELECT {_AGE_SQL} AS key, count(*) AS "count", {rank_sql("key", overview.AGE_ORDER)} AS ord '
    "FROM scoped GROUP BY 1",
    _SCOPED,
)(lambda current: overview.buckets(current, _SCOPE, overview.age_bucket(NOW), overview.AGE_ORDER))

on_current(
    "overview_time_to_fix",
    f'SELECT {_FIX_SQL} AS key, count(*) AS "count", {rank_sql("key", overview.FIX_ORDER)} AS ord '
    "FROM scoped GROUP BY 1",
    _SCOPED,
)(
    lambda current: overview.buckets(
        current, _SCOPE, overview.time_to_fix_bucket(), overview.FIX_ORDER
    )
)

on_current(
    "overview_trend",
    "SELECT strftime(\"publishedAt\", '%Y-%m') AS month, count(*) AS \"count\" FROM scoped "
    'WHERE "publishedAt" IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 600',
    _SCOPED,
)(lambda current: overview.published_trend(current, _SCOPE))

_TOP_LISTS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, row_number() OVER (ORDER BY \"count\" DESC, value) AS ord, value AS key, "
    f'value AS label, "count", -1.0::DOUBLE AS value FROM ({sql})'
    for m, sql in _DIMENSION_SQL.items()
)
_TIMES = (
    f"SELECT 'ageBuckets' AS metric, {rank_sql('key', overview.AGE_ORDER)} AS ord, key, key AS label, "
    f'"count", -1.0::DOUBLE AS value FROM (SELECT {_AGE_SQL} AS key, count(*) AS "count" FROM scoped GROUP BY 1) '
    f"UNION ALL SELECT 'timeToFixBuckets', {rank_sql('key', overview.FIX_ORDER)}, key, key, \"count\", -1 "
    f'FROM (SELECT {_FIX_SQL} AS key, count(*) AS "count" FROM scoped GROUP BY 1) '
    "UNION ALL SELECT 'publishedTrend', row_number() OVER (ORDER BY key), key, key, \"count\", -1 FROM "
    "(SELECT strftime(\"publishedAt\", '%Y-%m') AS key, count(*) AS \"count\" FROM scoped "
    'WHERE "publishedAt" IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 600)'
)
_SPLITS = """
SELECT 'totals' AS metric, 1::BIGINT AS ord, 'total' AS key, 'Total' AS label, total AS "count", -1.0::DOUBLE AS value FROM core
UNION ALL SELECT 'totals', 2, 'uniqueCves', 'Unique CVEs', "uniqueCves", -1 FROM core
UNION ALL SELECT 'totals', 3, 'analysisCount', 'Analysis', "analysisCount", -1 FROM core
UNION ALL SELECT 'totals', 4, 'aiAnalysisCount', 'AI Analysis', "aiAnalysisCount", -1 FROM core
UNION ALL SELECT 'totals', 5, 'averageCvss', 'Average CVSS', -1, "averageCvss" FROM core
UNION ALL SELECT 'statusDistribution', 1, 'open', 'Open', total - "fixedStatus", -1 FROM core
UNION ALL SELECT 'statusDistribution', 2, 'fixed', 'Fixed', "fixedStatus", -1 FROM core
UNION ALL SELECT 'fixAvailability', 1, 'available', 'Fix available', "fixAvailable", -1 FROM core
UNION ALL SELECT 'fixAvailability', 2, 'unavailable', 'No fix available', total - "fixAvailable", -1 FROM core
UNION ALL SELECT 'cvesFoundVsFixed', 1, 'found', 'found', "uniqueCves", -1 FROM core
UNION ALL SELECT 'cvesFoundVsFixed', 2, 'fixed', 'fixed', "fixedCves", -1 FROM core
"""
_WITH_CORE = f"{_SCOPED}, core AS ({_CORE_SQL})"


def _rounded(bundle: DataFrame) -> DataFrame:
    return bundle.withColumns(
        {
            "count": F.coalesce("count", F.lit(-1).cast("long")),
            "value": F.coalesce(F.round("value", 6), F.lit(-1.0)),
        }
    )


on_current("overview_dimensions", f"SELECT metric, ord, key, \"count\" FROM ({_TOP_LISTS})", _SCOPED)(
    lambda current: overview.distributions(current, _SCOPE, NOW).where(
        F.col("metric").isin(*_DIMENSION_SQL)
    )
)
on_current("overview_splits", _SPLITS, _WITH_CORE)(
    lambda current: _rounded(overview.splits(overview.overview_core(current, _SCOPE)))
)
on_current("overview_all", f"{_SPLITS} UNION ALL {_TOP_LISTS} UNION ALL {_TIMES}", _WITH_CORE)(
    lambda current: _rounded(overview.overview(current, _SCOPE, NOW))
)

_EVERY = _WITH_CORE.replace(_SCOPED, "scoped AS (SELECT * FROM findings)")
on_current("overview_unfiltered", f"{_SPLITS} UNION ALL {_TOP_LISTS} UNION ALL {_TIMES}", _EVERY)(
    lambda current: _rounded(overview.overview(current, QuerySpec(), NOW))
)
