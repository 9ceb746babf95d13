"""Overview aggregates: totals, top dimensions, age, time to fix and trend."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.functions.values import ordered_rank
from vulnlake.operators.predicates import mode_matches, overview_scope
from vulnlake.operators.top import counts_of_lists, ranked, top_counts
from vulnlake.spec import QuerySpec, utc

# Metric names, labels, bucket orders and list sizes.
DIMENSIONS = {
    "severityDistribution": "severity",
    "byRepository": "repo",
    "byImage": "image",
    "topPackages": "packageName",
}
RISK_DIMENSION = "riskFactorDistribution"
AGE_ORDER = ("0-30d", "31-90d", "91-365d", "1-5y", "5y+", "unknown")
FIX_ORDER = ("0-6d", "7-29d", "30-89d", "90-364d", "1y+", "unresolved")
#: Sizes of the public contract; the functions take others.
TOP_DIMENSION = 20
TREND_MONTHS = 600


def is_fixed() -> Column:
    return F.startswith(F.lower("status"), F.lit(fields.FIXED_STATUS_PREFIX))


def has_fix() -> Column:
    return F.array_contains("riskFactors", fields.HAS_FIX_FACTOR)


def overview_core(current: DataFrame, spec: QuerySpec) -> DataFrame:
    """One row of totals.

    Rows are first counted per CVE, which is also what makes both distinct
    counts exact: no row is expanded, and a very common CVE is one partial
    sum per task.
    """
    per_cve = (
        current.where(overview_scope(spec))
        .groupBy("cve")
        .agg(
            F.count("*").alias("n"),
            F.count_if(mode_matches("analysis")).alias("analysis"),
            F.count_if(mode_matches("aiAnalysis")).alias("ai"),
            F.sum("cvss").alias("cvss"),
            F.count("cvss").alias("scored"),
            F.count_if(is_fixed()).alias("fixed"),
            F.count_if(has_fix()).alias("fixable"),
        )
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0).cast("long"))

    return per_cve.agg(
        total("n").alias("total"),
        F.count("*").alias("uniqueCves"),
        total("analysis").alias("analysisCount"),
        total("ai").alias("aiAnalysisCount"),
        F.coalesce(F.try_divide(F.sum("cvss"), F.sum("scored")), F.lit(0.0)).alias("averageCvss"),
        total("fixed").alias("fixedStatus"),
        total("fixable").alias("fixAvailable"),
        F.count_if(F.col("fixed") > 0).alias("fixedCves"),
    )


def age_bucket(as_of: datetime) -> Column:
    """Age of publishedAt at `as_of`; future dates count as newest."""
    published, now = F.col("publishedAt"), F.lit(utc(as_of))
    return (
        F.when(published.isNull(), "unknown")
        .when(published >= now - F.make_interval(days=F.lit(30)), "0-30d")
        .when(published >= now - F.make_interval(days=F.lit(90)), "31-90d")
        .when(published >= now - F.make_interval(years=F.lit(1)), "91-365d")
        .when(published >= now - F.make_interval(years=F.lit(5)), "1-5y")
        .otherwise("5y+")
    )


def time_to_fix_bucket() -> Column:
    published, fixed = F.col("publishedAt"), F.col("fixedAt")
    days = F.datediff(fixed, published)
    return (
        F.when(fixed.isNull() | published.isNull() | (fixed <= published), "unresolved")
        .when(days < 7, "0-6d")
        .when(days < 30, "7-29d")
        .when(days < 90, "30-89d")
        .when(days < 365, "90-364d")
        .otherwise("1y+")
    )


def published_month() -> Column:
    return F.date_format("publishedAt", "yyyy-MM")


def top_dimension(current: DataFrame, spec: QuerySpec, metric: str,
                  size: int = TOP_DIMENSION) -> DataFrame:
    """Top values of one dimension: (value, count)."""
    scoped = current.where(overview_scope(spec))
    if metric == RISK_DIMENSION:
        return top_counts(scoped.select(F.explode("riskFactors").alias("v")), F.col("v"),
                          size)
    return top_counts(scoped, F.col(DIMENSIONS[metric]), size)


def buckets(current: DataFrame, spec: QuerySpec, key: Column, order: tuple[str, ...]) -> DataFrame:
    """(key, count, ord) of one bucketed distribution; empty buckets are absent."""
    return (
        current.where(overview_scope(spec))
        .groupBy(key.alias("key"))
        .agg(F.count("*").alias("count"))
        .withColumn("ord", ordered_rank(F.col("key"), order))
    )


def published_trend(current: DataFrame, spec: QuerySpec, months: int = TREND_MONTHS) -> DataFrame:
    """(month, count), the first `months` months."""
    return (
        current.where(overview_scope(spec) & F.col("publishedAt").isNotNull())
        .groupBy(published_month().alias("month"))
        .agg(F.count("*").alias("count"))
        .orderBy("month")
        .limit(months)
    )


def distributions(current: DataFrame, spec: QuerySpec, as_of: datetime,
                  size: int = TOP_DIMENSION, months: int = TREND_MONTHS) -> DataFrame:
    """Every counted distribution as (metric, ord, key, count) in one scan."""
    scalars = {
        **{metric: F.col(column) for metric, column in DIMENSIONS.items()},
        "ageBuckets": age_bucket(as_of),
        "timeToFixBuckets": time_to_fix_bucket(),
        "publishedTrend": published_month(),
    }
    counts = counts_of_lists(
        current.where(overview_scope(spec)),
        scalars,
        (RISK_DIMENSION, F.col("riskFactors")),
        "metric",
        "key",
    )
    by_month = F.col("metric") == "publishedTrend"
    order = [F.when(by_month, F.lit(0)).otherwise(-F.col("count")), F.col("key")]
    top = ranked(counts, "metric", order, max(size, months)).where(
        F.col("ord") <= F.when(by_month, months).otherwise(size)
    )
    place = (
        F.when(F.col("metric") == "ageBuckets", ordered_rank(F.col("key"), AGE_ORDER))
        .when(F.col("metric") == "timeToFixBuckets", ordered_rank(F.col("key"), FIX_ORDER))
        .otherwise(F.col("ord").cast("long"))
    )
    return top.select("metric", place.alias("ord"), "key", "count")


def splits(core: DataFrame) -> DataFrame:
    """Totals and two-way splits of the core row as (metric, ord, key, label, count)."""
    total = F.col("total")
    entries = [
        ("totals", 1, "total", "Total", total),
        ("totals", 2, "uniqueCves", "Unique CVEs", F.col("uniqueCves")),
        ("totals", 3, "analysisCount", "Analysis", F.col("analysisCount")),
        ("totals", 4, "aiAnalysisCount", "AI Analysis", F.col("aiAnalysisCount")),
        ("statusDistribution", 1, "open", "Open", total - F.col("fixedStatus")),
        ("statusDistribution", 2, "fixed", "Fixed", F.col("fixedStatus")),
        ("fixAvailability", 1, "available", "Fix available", F.col("fixAvailable")),
        ("fixAvailability", 2, "unavailable", "No fix available", total - F.col("fixAvailable")),
        ("cvesFoundVsFixed", 1, "found", "found", F.col("uniqueCves")),
        ("cvesFoundVsFixed", 2, "fixed", "fixed", F.col("fixedCves")),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(place).cast("long").alias("ord"),
                F.lit(key).alias("key"),
                F.lit(label).alias("label"),
                count.alias("count"),
                F.lit(None).cast("double").alias("value"),
            )
            for metric, place, key, label, count in entries
        ],
        F.struct(
            F.lit("totals").alias("metric"),
            F.lit(5).cast("long").alias("ord"),
            F.lit("averageCvss").alias("key"),
            F.lit("Average CVSS").alias("label"),
            F.lit(None).cast("long").alias("count"),
            F.col("averageCvss").alias("value"),
        ),
    )
    return core.select(F.inline(rows))


def overview(current: DataFrame, spec: QuerySpec, as_of: datetime,
             size: int = TOP_DIMENSION, months: int = TREND_MONTHS) -> DataFrame:
    """The whole bundle as (metric, ord, key, label, count, value)."""
    counted = distributions(current, spec, as_of, size, months).select(
        "metric",
        "ord",
        "key",
        F.col("key").alias("label"),
        "count",
        F.lit(None).cast("double").alias("value"),
    )
    return splits(overview_core(current, spec)).unionByName(counted)
