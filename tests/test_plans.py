"""Physical plans: what is pruned, pushed down and scanned once."""

import io
from contextlib import redirect_stdout

import pytest

from vulnlake.operators import facets, overview, paging, suggest, versions
from vulnlake.operators.predicates import page_scope
from vulnlake.plans.catalog import NOW
from vulnlake.sources.star_schema import current_findings, findings_log
from vulnlake.spec import QuerySpec, resolve_time_range

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def current(spark):
    return current_findings(spark, SF_DIR)


def scans(text):
    return text.split("\n\n")[0].count("Scan parquet")


def test_filters_and_columns_reach_the_scan(current):
    spec = QuerySpec(filters={"severity": ("high",)}, time_range=resolve_time_range("5y", NOW))
    text = plan(current.where(page_scope(spec)).select("cve"))
    assert "PushedFilters: [IsNotNull(publishedAt), EqualTo(severity,high)" in text or (
        "EqualTo(severity,high)" in text and "GreaterThanOrEqual(publishedAt" in text
    )
    assert "description" not in text.split("ReadSchema")[1].split("\n")[0]


def test_pages_use_top_k(current):
    text = plan(paging.page_rows(current, QuerySpec()))
    assert "TakeOrderedAndProject" in text
    assert "Exchange" not in text
    assert "description" not in text.split("ReadSchema")[1].split("\n")[0]


def test_collapse_ranks_before_the_shuffle(spark):
    text = plan(versions.collapse_current(findings_log(spark, SF_DIR)))
    assert text.split("\n\n")[0].count("WindowGroupLimit") == 2


@pytest.mark.parametrize(
    "build, expected",
    [
        (lambda c: facets.facets(c, QuerySpec(filters={"severity": ("high",)})), 1),
        (lambda c: overview.distributions(c, QuerySpec(), NOW), 1),
        (lambda c: overview.overview(c, QuerySpec(), NOW), 2),
        (lambda c: suggest.suggest_candidates(c, "r"), 1),
    ],
)
def test_scan_counts(current, build, expected):
    text = plan(build(current))
    assert scans(text) == expected
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "Expand"):
        assert forbidden not in text


def test_core_shuffles_one_partial_row_per_cve(current):
    text = plan(overview.overview_core(current, QuerySpec()))
    assert "Expand" not in text
    assert text.split("\n\n")[0].count("Exchange") == 2
