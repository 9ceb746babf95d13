"""Reports, batches and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.functions import values as fv
from vulnlake.operators import events, versions
from vulnlake.plans.catalog.registry import NOW, NOW_MS, on_current, query
from vulnlake.plans.ingest import ingest
from vulnlake.plans.relations import iso, over_findings
from vulnlake.session import scratch_path
from vulnlake.sources import corpus, star_events, tables
from vulnlake.sources.star_schema import DATASET_VERSION, current_findings, findings_log, table
from vulnlake.streaming.changes import FindingsTable

_STAMPED_FINDINGS = (
    "numbered AS (SELECT *, row_number() OVER (ORDER BY \"group\", repo, image, cve, \"packageName\", "
    '"packageVersion", path) - 1 AS n FROM findings)'
)


@on_current(
    "stamp_initial",
    f'SELECT "findingId", {NOW_MS} + n // 2000 AS updated_ms, n // 2000 + 1 AS batch, '
    "n - 2000 * (n // 2000) AS position FROM numbered",
    _STAMPED_FINDINGS,
)
def _stamp_initial(current: DataFrame) -> DataFrame:
    stamped = versions.stamp_initial(
        current.select(*fields.SOURCE_FIELDS, "findingId"), NOW, list(fields.IDENTITY)
    )
    return stamped.select(
        "findingId", F.unix_millis("updatedAt").alias("updated_ms"), "batch", "position"
    )


@query(
    "check_batches",
    """
    WITH batches AS (
      SELECT l_orderkey AS arrival,
        CASE WHEN o_custkey < 100 THEN l_orderkey - 50 ELSE l_orderkey + 1 END AS sequence,
        CASE WHEN o_orderpriority LIKE '5%' AND o_orderstatus = 'P' THEN 'star-0' ELSE 'star-1' END AS version,
        count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    seen AS (SELECT *, max(sequence) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM batches)
    SELECT arrival, sequence, 'version mismatch' AS reason FROM seen WHERE version <> 'star-1'
    UNION ALL SELECT arrival, sequence, 'sequence must increase' FROM seen WHERE sequence <= coalesce(highest, 0)
    UNION ALL SELECT arrival, sequence, 'too many rows' FROM seen WHERE n > 7
    """,
)
def _check_batches(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    outdated = F.col("o_orderpriority").startswith("5") & (F.col("o_orderstatus") == "P")
    source = joined.select(
        F.when(outdated, "star-0").otherwise("star-1").alias("dataset_version"),
        F.col("l_orderkey").alias("arrival"),
        F.when(F.col("o_custkey") < 100, F.col("l_orderkey") - 50)
        .otherwise(F.col("l_orderkey") + 1)
        .alias("sequence"),
    )
    return versions.check_batches(source, "star-1", max_rows=7)


@query(
    "ingest_report",
    over_findings(
        'SELECT count(DISTINCT batch) AS "batchesWritten", count(*) AS "sourceRowsWritten", '
        '(SELECT count(*) FROM findings) AS "currentFindings" FROM log'
    ),
)
def _ingest_report(spark: SparkSession, d: str) -> DataFrame:
    report = tables.ingest_report(findings_log(spark, d), current_findings(spark, d))
    return report.select("batchesWritten", "sourceRowsWritten", "currentFindings")


@query(
    "write_log",
    over_findings('SELECT severity, count(*) AS "rows", count(DISTINCT batch) AS batches '
                  "FROM log GROUP BY ALL"),
)
def _write_log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "log")
    tables.load_initial(findings_log(spark, d), path, DATASET_VERSION)
    return (
        tables.read_log(spark, path, DATASET_VERSION)
        .groupBy("severity")
        .agg(F.count("*").alias("rows"), F.countDistinct("batch").alias("batches"))
    )


@query(
    "load_modes",
    over_findings('SELECT count(*) AS "rows", 1::BIGINT AS refusals FROM findings'),
)
def _load_modes(spark: SparkSession, d: str) -> DataFrame:
    """A first load, a refused second one, and a replacing one."""
    current, path, refusals = current_findings(spark, d), scratch_path(spark, "log"), 0
    tables.load_initial(current, path, DATASET_VERSION)
    try:
        tables.load_initial(current, path, DATASET_VERSION)
    except tables.TableNotEmpty:
        refusals += 1
    tables.load_initial(current, path, DATASET_VERSION, replace=True)
    return tables.read_log(spark, path, DATASET_VERSION).agg(
        F.count("*").alias("rows"), F.lit(refusals).cast("long").alias("refusals")
    )


@query(
    "dataset_info",
    over_findings(
        "SELECT 'star-1' AS version, count(*) AS \"totalCount\", (SELECT (epoch_us(ts) // 1000) || '-' || event_id "
        'FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS "lastEventId" FROM findings'
    ),
)
def _dataset_info(spark: SparkSession, d: str) -> DataFrame:
    return events.dataset_info(
        current_findings(spark, d), star_events.events_of(spark, d), DATASET_VERSION
    )


_CENSUS_DOCS = """
docs AS (
  SELECT n_name AS g, s_name AS r, l_returnflag || l_linestatus AS i,
    CASE WHEN l_linenumber > 3 THEN 'image ' || l_returnflag END AS name,
    CASE WHEN l_discount = 0 THEN 0 WHEN l_tax = 0 THEN 2 ELSE 1 END AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'idle ' || s_name, NULL, NULL, NULL
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT r_name, NULL, NULL, NULL, NULL FROM region)
"""


@query(
    "census",
    f"""
    WITH {_CENSUS_DOCS}
    SELECT count(DISTINCT g) AS "groups", count(DISTINCT CASE WHEN r IS NOT NULL THEN [g, r] END) AS repos,
      count(DISTINCT CASE WHEN i IS NOT NULL THEN [g, r, i] END) AS "imageKeys",
      count(DISTINCT name) AS "imageNames", count(n) AS "vulnArrays",
      count(*) FILTER (n > 0) AS "nonEmptyVulnArrays", CAST(sum(n) AS BIGINT) AS "vulnTotal" FROM docs
    """,
)
def _census(spark: SparkSession, d: str) -> DataFrame:
    return corpus.census(
        corpus.parse_documents(star_events.census_documents(spark, d), "text")
    )


@query(
    "empty_groups",
    f"""
    WITH {_CENSUS_DOCS}, sizes AS (SELECT g, sum(coalesce(n, 0)) AS n FROM docs GROUP BY g)
    SELECT (SELECT count(*) FROM sizes) AS "groups", g AS "groupKey" FROM sizes WHERE n = 0
    """,
)
def _empty_groups(spark: SparkSession, d: str) -> DataFrame:
    return corpus.empty_groups(
        corpus.parse_documents(star_events.census_documents(spark, d), "text")
    )


@query(
    "load_refused",
    over_findings(
        "SELECT severity, count(*) AS findings, round(sum(cvss), 4) AS cvss_sum, 1::BIGINT AS events, "
        "'kept populated unreadable unexpected' AS refusals FROM findings GROUP BY severity"
    ),
)
def _load_refused(spark: SparkSession, d: str) -> DataFrame:
    """A load and three refused ones that would replace it: its rows and events stay."""
    root = scratch_path(spark, "lake")
    texts = star_events.report_documents(current_findings(spark, d)).select("text")
    # Cut short, a tenth of the reports is not JSON.
    cut = F.when(F.crc32("text") % 10 == 0, F.substring("text", 1, 40)).otherwise(F.col("text"))
    whole = corpus.parse_documents(texts, "text")
    broken = corpus.parse_documents(texts.select(cut.alias("text")), "text")
    ingest(whole, root, DATASET_VERSION, NOW)
    asked = {
        "populated": lambda: ingest(whole, root, DATASET_VERSION, NOW),
        "unreadable": lambda: ingest(broken, root, DATASET_VERSION, NOW, replace=True),
        "unexpected": lambda: ingest(whole.limit(5), root, DATASET_VERSION, NOW, replace=True, expected_rows=1),
    }
    refusals = ["kept"]
    for name, load in asked.items():
        try:
            load()
        except (tables.TableNotEmpty, versions.ContractViolation):
            refusals.append(name)
    findings = FindingsTable.open(spark, root, DATASET_VERSION)
    return (
        findings.current()
        .groupBy("severity")
        .agg(F.count("*").alias("findings"), F.round(F.sum("cvss"), 4).alias("cvss_sum"))
        .select("*", F.lit(findings.events().count()).alias("events"), F.lit(" ".join(refusals)).alias("refusals"))
    )


def flattened(current: DataFrame) -> DataFrame:
    return corpus.flatten_source(
        corpus.parse_documents(star_events.report_documents(current), "text")
    )


@on_current(
    "flatten_roundtrip",
    'SELECT "findingId", "group", repo, image, cve, severity, cvss, "buildType", '
    "coalesce(\"kaiStatus\", '(none)') AS \"kaiStatus\", "
    "array_to_string(list_sort(\"riskFactors\"), '|') AS \"riskFactors\", "
    "array_to_string(\"applicableRules\", '|') AS \"applicableRules\", "
    f"{iso('publishedAt')} AS \"publishedAt\", coalesce({iso('fixedAt')}, '(none)') AS \"fixedAt\" "
    "FROM findings",
)
def _flatten_roundtrip(current: DataFrame) -> DataFrame:
    derived = versions.derive(corpus.normalize(flattened(current)))
    return derived.select(
        "findingId",
        "group",
        "repo",
        "image",
        "cve",
        "severity",
        "cvss",
        "buildType",
        F.coalesce("kaiStatus", F.lit("(none)")).alias("kaiStatus"),
        F.array_join("riskFactors", "|").alias("riskFactors"),
        F.array_join("applicableRules", "|").alias("applicableRules"),
        fv.iso_ms(F.col("publishedAt")).alias("publishedAt"),
        F.coalesce(fv.iso_ms(F.col("fixedAt")), F.lit("(none)")).alias("fixedAt"),
    )


@query(
    "read_source",
    over_findings(
        'SELECT "group", repo, image, count(*) AS records, round(sum(cvss), 4) AS cvss_sum '
        "FROM findings GROUP BY ALL"
    ),
)
def _read_source(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON lines and read back through the file reader."""
    path = scratch_path(spark, "reports")
    star_events.report_documents(current_findings(spark, d)).select("text").write.text(path, compression="gzip")
    read = corpus.read_source(spark, path, multi_line=False)
    return (
        corpus.normalize(corpus.flatten_source(read))
        .groupBy("group", "repo", "image")
        .agg(F.count("*").alias("records"), F.round(F.sum("cvss"), 4).alias("cvss_sum"))
    )


@on_current(
    "context_names",
    'SELECT "findingId" AS doc, "group", repo, image, "buildType" AS "imageBuildType", '
    "0::BIGINT AS position FROM findings",
)
def _context_names(current: DataFrame) -> DataFrame:
    return flattened(current).select(
        "doc",
        "group",
        "repo",
        "image",
        "imageBuildType",
        F.col("place.recordPlace").cast("long").alias("position"),
    )


_RECORD_SIZE = (
    "strlen(\"group\" || repo || image || cve || \"packageName\" || \"packageVersion\" || severity || status)"
)
_PREFIX = (
    f"sized AS (SELECT *, {_RECORD_SIZE} AS bytes FROM findings), "
    "running AS (SELECT *, sum(bytes) OVER (ORDER BY \"group\", repo, image, cve, \"packageName\", "
    '"packageVersion", path) - bytes AS before FROM sized)'
)


def _sample(current: DataFrame) -> DataFrame:
    text = F.concat(
        "group", "repo", "image", "cve", "packageName", "packageVersion", "severity", "status"
    )
    return corpus.sample_prefix(
        current, list(fields.IDENTITY), budget=2_000_000, size=F.octet_length(text)
    )


on_current(
    "sample_prefix",
    'SELECT "findingId", bytes FROM running WHERE before < 2000000',
    _PREFIX,
)(lambda current: _sample(current).select("findingId", "bytes"))

on_current(
    "sample_manifest",
    'SELECT count(*) AS "sourceRows", CAST(sum(bytes) AS BIGINT) AS "approxBytes" FROM running WHERE before < 2000000',
    _PREFIX,
)(lambda current: corpus.sample_manifest(_sample(current)))
