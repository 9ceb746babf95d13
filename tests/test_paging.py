import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.operators import paging
from vulnlake.operators.predicates import by_id, page_scope
from vulnlake.operators.rows import project_detail, project_explore
from vulnlake.operators.sorted_pages import SortedCopy
from vulnlake.spec import QuerySpec, Sort, TimeRange, parse_instant


@pytest.fixture(scope="module")
def current(log_rows):
    rng = random.Random(11)
    entries = []
    for n in range(90):
        published = rng.choice(["", f"2024-01-{rng.randrange(1, 9):02d}T00:00:00Z", "bad"])
        fixed = rng.choice(["", f"2024-02-{rng.randrange(1, 5):02d}"])
        entries.append({
            "cve": f"CVE-{n % 7}", "packageVersion": str(n), "packageName": rng.choice("abc"),
            "repo": rng.choice(["r1", "R2", "100%_x"]), "severity": rng.choice(["high", "low", ""]),
            "cvss": rng.choice([0.0, 5.5, 9.8]), "published": published, "fixDate": fixed,
            "ms": rng.randrange(4), "kaiStatus": rng.choice([None, "", "reviewed"]),
            "riskFactors": rng.sample(["Has fix", "reachable", "Remote"], rng.randrange(3)),
        })
    return log_rows(*entries).cache()


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize("field", fields.SORTABLE)
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_walking_pages_yields_every_row_once_in_order(current, field, direction):
    sort = Sort(field, direction)
    expected = [
        r.findingId for r in current.orderBy(*paging.total_order(sort)).collect()
    ]
    seen, after = [], None
    while True:
        rows = paging.page(current, QuerySpec(sort=sort, first=40, after=after)).orderBy(
            "position"
        ).collect()
        seen += [r.id for r in rows]
        assert all(r.hasNextPage == rows[0].hasNextPage for r in rows)
        if not rows or not rows[0].hasNextPage:
            break
        after = rows[-1].cursor
    assert seen == expected


def test_fetched_pages_equal_lazy_pages(current):
    spec = QuerySpec(sort=Sort("fixedAt", "asc"), first=30)
    while True:
        fetched = paging.fetch_page(current, spec)
        lazy = paging.page(current, spec).orderBy("position").collect()
        assert [(r.id, r.cursor) for r in fetched.rows] == [(r.id, r.cursor) for r in lazy]
        assert all(r.hasNextPage == fetched.has_next_page for r in lazy)
        if not fetched.has_next_page:
            break
        spec = replace(spec, after=fetched.end_cursor)
    assert paging.fetch_page(current, QuerySpec(search="%none%")) == paging.Page([], None, False)


def test_cursor_does_not_change_the_total(current):
    last = paging.page(current, QuerySpec(first=5)).orderBy(F.desc("position")).first()
    spec = QuerySpec(first=5, after=last.cursor)
    assert paging.total_count(current, spec).first().total == 90


def test_filters_match_a_row_model(current):
    rows = current.collect()

    def kept(spec):
        return sorted(r.findingId for r in current.where(page_scope(spec)).collect())

    def model(test):
        return sorted(r.findingId for r in rows if test(r))

    assert kept(QuerySpec(filters={"kaiStatus": ("",)})) == model(lambda r: not r.kaiStatus)
    assert kept(QuerySpec(filters={"kaiStatus": ("reviewed",)})) == model(
        lambda r: r.kaiStatus == "reviewed")
    assert kept(QuerySpec(filters={"severity": ("",), "riskFactors": ("Remote", "x")})) == model(
        lambda r: r.severity == "" and "Remote" in r.riskFactors)
    assert kept(QuerySpec(search="%_")) == model(lambda r: "%_" in r.repo)
    assert kept(QuerySpec(search="r2")) == model(lambda r: "r2" in r.repo.lower())
    bounds = TimeRange(parse_instant("2024-01-02T00:00:00Z"), parse_instant("2024-01-05T00:00:00Z"))
    assert kept(QuerySpec(time_range=bounds)) == model(
        lambda r: r.publishedAt and 2 <= r.publishedAt.day <= 5)


def test_modes_exclude_one_exact_status(log_rows):
    statuses = [None, "", "invalid - norisk", " invalid - norisk", "Invalid - norisk",
                "ai-invalid-norisk"]
    current = log_rows(*[{"cve": str(n), "kaiStatus": s} for n, s in enumerate(statuses)])

    def kept(mode):
        return sorted(int(r.cve) for r in current.where(page_scope(QuerySpec(mode=mode))).collect())

    assert kept("all") == [0, 1, 2, 3, 4, 5]
    assert kept("analysis") == [0, 1, 3, 4, 5]
    assert kept("aiAnalysis") == [0, 1, 2, 3, 4]


def test_projections_and_lookup(current):
    assert project_explore(current).columns == list(fields.EXPLORE)
    assert project_detail(current).columns == list(fields.DETAIL)
    id = current.first().findingId
    assert by_id(current, id).count() == 1
    assert by_id(current, "0" * 32).count() == 0
    with pytest.raises(ValueError):
        by_id(current, "0")


def test_collect_bounded_fails_instead_of_cutting(current):
    assert len(paging.collect_bounded(current, 90)) == 90
    with pytest.raises(paging.ResultTooLarge):
        paging.collect_bounded(current, 89)


def test_entry_points_agree_with_the_operators(spark, current, tmp_path):
    from datetime import datetime, timezone

    from vulnlake.operators.events import EVENT_SCHEMA
    from vulnlake.operators.export import ExportStore
    from vulnlake.plans.api import Findings

    now = datetime(2024, 6, 1, tzinfo=timezone.utc)
    findings = Findings(current, spark.createDataFrame([], EVENT_SCHEMA), "v1")
    spec = QuerySpec(filters={"severity": ("high",)}, first=10)
    total = findings.total_count(spec).first().total
    assert findings.page(spec).count() == min(10, total)
    high = findings.facets(QuerySpec()).where("facet = 'severity' AND value = 'high'").first()
    assert high["count"] == total
    bundle = findings.overview(spec, now).where("key = 'total'").first()
    assert bundle["count"] == total
    both = findings.compare(spec, "all", "all").where("metric = 'total'").first()
    assert (both.left, both.delta) == (total, 0)
    id = current.first().findingId
    assert findings.finding(id).first().id == id
    assert findings.suggest("cve").count() == 7
    assert findings.dataset_info().first().totalCount == 90
    assert findings.replay("1-0").count() == 0
    job = findings.export(ExportStore(spark, str(tmp_path)), spec, now)
    assert (job["status"], job["rowCount"]) == ("READY", total)


def test_a_sorted_copy_reads_few_files_and_pages_as_the_table(spark, log_rows, tmp_path):
    rows = [{"cve": f"CVE-{k}", "cvss": float(k % 7), "severity": "low" if k % 50 else "high"} for k in range(400)]
    current = log_rows(*rows)
    copy = SortedCopy(spark, str(tmp_path / "copy"))
    copy.write(current, rows_per_file=20)
    files = copy.files(QuerySpec(), 1000)
    assert len(files) >= 20
    after, seen = None, []
    for _ in range(9):
        spec = QuerySpec(first=50, after=after)
        assert copy.fetch_page(spec) == paging.fetch_page(current, spec)
        page = copy.fetch_page(spec)
        seen += [r.id for r in page.rows]
        if page.end_cursor is None:
            break
        after = page.end_cursor
    assert len(seen) == len(set(seen)) == 400
    second = QuerySpec(first=10, after=paging.fetch_page(current, QuerySpec(first=200)).end_cursor)
    read = copy._read(second, lambda some: paging.page_rows(some, second).count() > second.first)
    assert len(read.inputFiles()) <= len(files) // 5
    rare = QuerySpec(first=5, filters={"severity": ("high",)})
    assert copy.fetch_page(rare) == paging.fetch_page(current, rare)
    assert copy.page(rare).collect() == paging.page(current, rare).collect()
    with pytest.raises(ValueError):
        copy.fetch_page(QuerySpec(sort=Sort("severity", "asc")))


@pytest.mark.parametrize("sort", [Sort("cvss", "desc"), Sort("cvss", "asc"), Sort("fixedAt", "desc"), Sort("publishedAt", "asc"), Sort("severity", "asc")])
def test_passes_of_a_sorted_copy_share_its_rows(spark, log_rows, tmp_path, sort):
    rows = [
        {"cve": f"CVE-{k}", "cvss": float(k % 3), "severity": "low" if k % 4 else "high",
         "fixDate": f"2024-01-0{k % 5}" if k % 5 else "", "published": f"2024-02-0{k % 4 + 1}" if k % 7 else ""}
        for k in range(120)
    ]
    current = log_rows(*rows, *rows[:10])
    copy = SortedCopy(spark, str(tmp_path / "copy"), sort)
    copy.write(current, rows_per_file=5, rows_per_pass=20)
    assert len({f.split("/")[-2] for f in copy.files(QuerySpec(sort=sort), 1000)}) >= 4
    kept = [r for f in copy.files(QuerySpec(sort=sort), 1000) for r in spark.read.parquet(f).select("findingId").collect()]
    assert [r.findingId for r in kept] == [r.findingId for r in current.orderBy(*paging.total_order(sort)).collect()]
    spec = QuerySpec(sort=sort, first=30, after=paging.fetch_page(current, QuerySpec(sort=sort, first=70)).end_cursor)
    assert copy.page(spec).collect() == paging.page(current, spec).collect()
    copy.write(current.limit(3), rows_per_file=5, rows_per_pass=20)
    assert len(copy.files(QuerySpec(sort=sort), 1000)) <= 3


def test_a_sorted_copy_reads_the_table_few_times(spark, log_rows, tmp_path):
    current = log_rows(*({"cve": f"CVE-{k}", "cvss": float(k)} for k in range(40)))
    copy = SortedCopy(spark, str(tmp_path / "copy"))
    copy.write(current, rows_per_file=5, rows_per_pass=1)
    files = copy.files(QuerySpec(), 1000)
    assert len({f.split("/")[-2] for f in files}) == 4
    assert sum(spark.read.parquet(f).count() for f in files) == 40
