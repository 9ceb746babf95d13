import random
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.operators import compare, facets, overview, suggest
from vulnlake.spec import QuerySpec

NOW = datetime(2024, 2, 29, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def current(log_rows):
    rng = random.Random(23)
    return log_rows(*[
        {
            "cve": f"CVE-{rng.randrange(30)}", "packageVersion": str(n),
            "packageName": rng.choice(["nginx", "openssl", "zlib"]),
            "image": f"img:{rng.randrange(40)}", "repo": rng.choice(["api", "web"]),
            "severity": rng.choice(["critical", "high", "low", "odd", ""]),
            "status": rng.choice(["Fixed in 2", "FIXED", "open", ""]),
            "kaiStatus": rng.choice([None, "", "invalid - norisk", "ai-invalid-norisk"]),
            "riskFactors": [rng.choice(["Has fix", "reachable"]) for _ in range(rng.randrange(4))],
            "cvss": float(rng.randrange(10)), "advisoryType": rng.choice("AB"),
            "published": rng.choice(["", "2024-02-20", "2023-12-15", "2023-04-01", "2020-01-01",
                                     "2001-05-05", "2030-01-01"]),
            "fixDate": rng.choice(["", "2024-02-21", "2024-03-10", "2020-03-01", "2024-05-01"]),
        }
        for n in range(400)
    ]).cache()


SPEC = QuerySpec(
    filters={"severity": ("critical", ""), "kaiStatus": ("", "ai-invalid-norisk"),
             "riskFactors": ("Has fix",)},
    mode="analysis", search="not used",
)


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("spec", [QuerySpec(), SPEC, QuerySpec(filters={"repo": ("none",)})])
def test_one_pass_facets_equal_branches(current, spec):
    assert as_set(facets.facets(current, spec)) == as_set(facets.facets_by_branch(current, spec))


def test_facet_counts_match_a_model(current):
    rows = [r for r in current.collect()
            if r.kaiStatus != "invalid - norisk" and "Has fix" in r.riskFactors
            and r.severity in ("critical", "")]
    expected = Counter(r.kaiStatus or "" for r in rows)
    got = {r.value: r["count"] for r in facets.facet(current, SPEC, "kaiStatus").collect()}
    assert got == dict(expected)


def test_top_lists_order_by_count_then_value(current):
    got = [(r.value, r["count"]) for r in
           overview.top_dimension(current, QuerySpec(), "byImage").collect()]
    counts = Counter(r.image for r in current.collect())
    assert got == sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:20]


def test_overview_matches_a_model(current):
    spec = QuerySpec(filters={"advisoryType": ("A",)}, mode="analysis", search="not used")
    rows = [r for r in current.collect() if r.advisoryType == "A"]
    bundle = overview.overview(current, spec, NOW).collect()
    counts = {(r.metric, r.key): r["count"] for r in bundle}
    fixed = [r for r in rows if r.status.lower().startswith("fixed")]
    assert counts["totals", "total"] == len(rows)
    assert counts["totals", "uniqueCves"] == len({r.cve for r in rows})
    assert counts["totals", "analysisCount"] == sum(r.kaiStatus != "invalid - norisk" for r in rows)
    assert counts["totals", "aiAnalysisCount"] == sum(
        r.kaiStatus != "ai-invalid-norisk" for r in rows)
    assert counts["statusDistribution", "open"] == len(rows) - len(fixed)
    assert counts["cvesFoundVsFixed", "fixed"] == len({r.cve for r in fixed})
    assert counts["fixAvailability", "available"] == sum("Has fix" in r.riskFactors for r in rows)
    average = next(r.value for r in bundle if r.key == "averageCvss")
    assert average == pytest.approx(sum(r.cvss for r in rows) / len(rows))
    # Repeats inside one array count each time.
    risk = Counter(f for r in rows for f in r.riskFactors)
    assert counts["riskFactorDistribution", "Has fix"] == risk["Has fix"]
    severities = sum(c for (m, _), c in counts.items() if m == "severityDistribution")
    assert severities == len(rows)
    ages = [(r.ord, r.key) for r in sorted(bundle, key=lambda r: r.ord) if r.metric == "ageBuckets"]
    assert ages == [(i + 1, k) for i, k in enumerate(overview.AGE_ORDER)]
    trend = [r.key for r in sorted(bundle, key=lambda r: r.ord) if r.metric == "publishedTrend"]
    assert trend == sorted({r.publishedAt.strftime("%Y-%m") for r in rows if r.publishedAt})


def test_distributions_equal_their_single_forms(current):
    spec = QuerySpec(filters={"advisoryType": ("B",)})
    together = {}
    for r in overview.distributions(current, spec, NOW).collect():
        together.setdefault(r.metric, []).append((r.ord, r.key, r["count"]))
    for metric in (*overview.DIMENSIONS, overview.RISK_DIMENSION):
        alone = overview.top_dimension(current, spec, metric).collect()
        assert sorted(together[metric]) == [
            (n + 1, r.value, r["count"]) for n, r in enumerate(alone)
        ]
    for metric, key, order in [
        ("ageBuckets", overview.age_bucket(NOW), overview.AGE_ORDER),
        ("timeToFixBuckets", overview.time_to_fix_bucket(), overview.FIX_ORDER),
    ]:
        alone = overview.buckets(current, spec, key, order).collect()
        assert sorted(together[metric]) == sorted((r.ord, r.key, r["count"]) for r in alone)


def test_bucket_edges(log_rows):
    def bucket(expression, **row):
        return log_rows(row).select(expression.alias("b")).first().b

    age = overview.age_bucket(NOW)
    assert bucket(age, published="2024-01-30") == "0-30d"
    assert bucket(age, published="2024-01-29T23:59:59Z") == "31-90d"
    assert bucket(age, published="2030-01-01") == "0-30d"
    assert bucket(age, published="2023-02-28") == "91-365d"
    assert bucket(age, published="2023-02-27") == "1-5y"
    assert bucket(age, published="2019-02-27") == "5y+"
    assert bucket(age, published="soon") == "unknown"
    fix = overview.time_to_fix_bucket()
    # Whole calendar days, not 24 hour spans.
    assert bucket(fix, published="2024-01-01T23:00:00Z", fixDate="2024-01-08T01:00:00Z") == "7-29d"
    assert bucket(fix, published="2024-01-01", fixDate="2024-01-01") == "unresolved"
    assert bucket(fix, published="2024-01-01", fixDate="2025-01-01") == "1y+"
    assert bucket(fix, published="", fixDate="2025-01-01") == "unresolved"


def test_empty_scope(current):
    spec = QuerySpec(filters={"repo": ("none",)})
    core = overview.overview_core(current, spec).first()
    assert (core.total, core.averageCvss, core.fixedCves) == (0, 0.0, 0)
    totals = compare.compare_modes(current, spec, "all", "analysis").collect()
    assert [(r.key, r.left, r.right) for r in totals if r.metric == "total"] == [("total", 0, 0)]


def test_compare_merge_golden(spark):
    schema = "value string, count long"
    left = spark.createDataFrame([("high", 2), ("zeta", 1), ("", 4)], schema)
    right = spark.createDataFrame([("critical", 3), ("high", 5), ("alpha", 1)], schema)
    rows = compare.compare_merge(left, right, compare.SEVERITY_ORDER).orderBy("rank", "key").collect()
    assert [(r.key, r.label, r.left, r.right, r.delta) for r in rows] == [
        ("critical", "critical", 0, 3, 3), ("high", "high", 2, 5, 3),
        ("", "(blank)", 4, 0, -4), ("alpha", "alpha", 0, 1, 1), ("zeta", "zeta", 1, 0, -1),
    ]


def test_compare_modes_equal_merged_facets(current):
    spec = QuerySpec(filters={"severity": ("critical", "odd"), "repo": ("api",)}, search="no")
    together = compare.compare_modes(current, spec, "analysis", "aiAnalysis")
    for field, order in compare.COMPARED.items():
        left, right = (
            facets.facet(current, QuerySpec(filters=spec.filters, mode=m), field)
            for m in ("analysis", "aiAnalysis")
        )
        merged = compare.compare_merge(left, right, order)
        alone = together.where(F.col("metric") == field).select(*merged.columns)
        assert as_set(alone) == as_set(merged)


def test_compare_keeps_200_values_per_mode(log_rows):
    rows = [{"cve": str(n), "severity": f"s{n:03d}",
             "kaiStatus": "invalid - norisk" if n < 30 else None} for n in range(260)]
    current = log_rows(*rows)
    together = compare.compare_modes(current, QuerySpec(), "analysis", "all")
    left, right = (facets.facet(current, QuerySpec(mode=m), "severity") for m in ("analysis", "all"))
    merged = compare.compare_merge(left, right, compare.SEVERITY_ORDER)
    alone = together.where("metric = 'severity'").select(*merged.columns)
    assert as_set(alone) == as_set(merged)


GOLDEN = [
    # Every field has a match: one of each.
    (
        [("cve", "CVE-1"), ("cve", "CVE-22"), ("cve", "CVE-333"), ("packageName", "lz4"),
         ("packageName", "libxml"), ("image", "base:1"), ("repo", "shop")], 4,
        [("CVE", "CVE-1"), ("PACKAGE_NAME", "lz4"), ("IMAGE", "base:1"), ("REPO", "shop")],
    ),
    # Two fields have none: the rest is filled in field order.
    (
        [("cve", "CVE-1"), ("cve", "CVE-22"), ("cve", "CVE-333"), ("packageName", "lz4")], 4,
        [("CVE", "CVE-1"), ("PACKAGE_NAME", "lz4"), ("CVE", "CVE-22"), ("CVE", "CVE-333")],
    ),
    # Repeats fold within a field, not across fields.
    (
        [("repo", "shop"), ("repo", "shop"), ("image", "shop")], 10,
        [("IMAGE", "shop"), ("REPO", "shop")],
    ),
    # A limit below the number of fields keeps the first fields.
    (
        [("repo", "shop"), ("image", "base:1"), ("cve", "CVE-1"), ("cve", "CVE-22")], 2,
        [("CVE", "CVE-1"), ("IMAGE", "base:1")],
    ),
]


@pytest.mark.parametrize("rows, limit, expected", GOLDEN)
def test_suggestion_ranking(spark, rows, limit, expected):
    df = spark.createDataFrame(
        [(f, v, n) for n, (f, v) in enumerate(rows)], "field string, value string, place int"
    )
    ranked = suggest.rank_suggestions(df, limit).orderBy("ord").collect()
    assert [(r.field, r.value) for r in ranked] == expected


def test_suggestions_are_shortest_in_bytes(log_rows):
    current = log_rows(*[{"cve": n, "packageVersion": n, "repo": "x", "image": "x",
                          "packageName": "x"} for n in ("aé", "abc", "Ab", "b", "")])
    got = suggest.suggest_candidates(current, "A", 2).orderBy("place").collect()
    assert [(r.field, r.value) for r in got] == [("cve", "Ab"), ("cve", "abc")]
    assert [r.value for r in suggest.suggest(current, "a").orderBy("ord").collect()] == [
        "Ab", "abc", "aé"]
    assert sorted(r.value for r in suggest.distinct_values(current, "cve", "AB").collect()) == [
        "Ab", "abc"]


def test_facets_report_every_filterable_field(current):
    names = {r.facet for r in facets.facets(current, QuerySpec()).select("facet").collect()}
    assert names == set(fields.FILTERABLE)
