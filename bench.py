"""Headline timings over the star-schema findings; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local width. Every query runs once to warm up; the median of
the following runs is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from vulnlake.operators import compare, events, export, facets, overview, paging, predicates
from vulnlake.operators import rows, suggest, versions
from vulnlake.operators.sorted_pages import SortedCopy
from vulnlake.plans.catalog import NOW, QUERIES
from vulnlake.session import scratch_path
from vulnlake.sources import star_events
from vulnlake.sources.star_schema import current_findings, findings_log
from vulnlake.sources.tables import write_current
from vulnlake.spec import QuerySpec, Sort

RUNS = 3


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vulnlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        # Small tables are read by all cores, as large ones are.
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df) -> None:
    """Run a plan to its end without moving its rows."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(cpus)
    current = current_findings(spark, sf_dir)
    log = star_events.events_of(spark, sf_dir)
    first = paging.fetch_page(current, QuerySpec())
    id = first.rows[0].id
    narrow = QuerySpec(filters={"severity": ("critical",)}, search="widget", mode="analysis")
    two_filters = QuerySpec(filters={"severity": ("critical", "high"), "status": ("open",)})
    tail = "eyJzIjogbnVsbCwgImlkIjogIjgwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwIn0"

    copy = SortedCopy(spark, scratch_path(spark, "sorted"))
    copy.write(current, rows_per_file=20_000)

    def registered(name):
        return lambda: drain(QUERIES[name](spark, sf_dir))

    queries = {
        "first_page": lambda: paging.fetch_page(current, QuerySpec()),
        "second_page": lambda: paging.fetch_page(current, QuerySpec(after=first.end_cursor)),
        "filtered_page": lambda: paging.fetch_page(current, narrow),
        "largest_page": lambda: paging.fetch_page(current, QuerySpec(first=200)),
        "null_tail_page": lambda: paging.fetch_page(
            current, QuerySpec(sort=Sort("fixedAt", "desc"), after=tail)
        ),
        "sorted_first_page": lambda: copy.fetch_page(QuerySpec()),
        "sorted_second_page": lambda: copy.fetch_page(QuerySpec(after=first.end_cursor)),
        "sorted_filtered_page": lambda: copy.fetch_page(narrow),
        "total_count": lambda: paging.total_count(current, narrow).collect(),
        "detail_by_id": lambda: rows.project_detail(predicates.by_id(current, id)).collect(),
        "overview": lambda: overview.overview(current, QuerySpec(), NOW).collect(),
        "facets": lambda: facets.facets(current, QuerySpec()).collect(),
        "facets_filtered": lambda: facets.facets(current, two_filters).collect(),
        "suggest": lambda: suggest.suggest(current, "R").collect(),
        "compare": lambda: compare.compare_modes(
            current, QuerySpec(), "analysis", "aiAnalysis"
        ).collect(),
        "collapse": lambda: drain(versions.collapse_current(findings_log(spark, sf_dir))),
        "build_current": lambda: write_current(
            versions.collapse_current(findings_log(spark, sf_dir)), scratch_path(spark, "bench")
        ),
        "version_audit": registered("version_audit"),
        "flatten_normalize": registered("flatten_roundtrip"),
        "apply_changes": registered("apply_changes"),
        "export_csv": lambda: export.write_csv(
            export.export_rows(current, QuerySpec()), scratch_path(spark, "bench")
        ),
        "event_validate": registered("event_valid"),
        "event_coalesce": lambda: drain(events.coalesce(log, "9 hours")),
    }
    only = set(sys.argv[1:])
    timings = {}
    for name, run in queries.items():
        if only and name not in only:
            continue
        run()
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken), 4)
    print(
        json.dumps(
            {
                "metric": "findings_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "current_findings": current.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
