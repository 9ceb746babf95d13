"""The version log and change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions import values as fv
from vulnlake.operators import versions
from vulnlake.plans.catalog.registry import NOW, NOW_MS, ORACLES, query
from vulnlake.plans.relations import iso, over_changes, over_findings
from vulnlake.session import scratch_path
from vulnlake.sources import star_events
from vulnlake.sources.star_schema import DATASET_VERSION, current_findings, findings_log, newest_findings, table
from vulnlake.streaming import changes as streaming

query(
    "log_rows",
    over_findings(
        'SELECT severity, status, count(*) AS "rows", round(sum(cvss), 4) AS cvss_sum '
        "FROM log GROUP BY ALL"
    ),
)(
    lambda spark, d: findings_log(spark, d)
    .groupBy("severity", "status")
    .agg(F.count("*").alias("rows"), F.round(F.sum("cvss"), 4).alias("cvss_sum"))
)

query("current_count", over_findings("SELECT count(*) AS total FROM findings"))(
    lambda spark, d: versions.collapse_current(findings_log(spark, d)).agg(
        F.count("*").alias("total")
    )
)

query(
    "current_rows",
    over_findings(
        'SELECT "findingId", "group", repo, image, cve, "packageName", "packageVersion", severity, '
        'status, cvss, coalesce("kaiStatus", \'(none)\') AS "kaiStatus", '
        f"array_to_string(\"riskFactors\", '|') AS \"riskFactors\", {iso('updatedAt')} AS \"updatedAt\", "
        f"coalesce({iso('fixedAt')}, '(none)') AS \"fixedAt\" FROM findings"
    ),
)(
    lambda spark, d: versions.collapse_current(findings_log(spark, d)).select(
        "findingId",
        "group",
        "repo",
        "image",
        "cve",
        "packageName",
        "packageVersion",
        "severity",
        "status",
        "cvss",
        F.coalesce("kaiStatus", F.lit("(none)")).alias("kaiStatus"),
        F.array_join("riskFactors", "|").alias("riskFactors"),
        fv.iso_ms(F.col("updatedAt")).alias("updatedAt"),
        F.coalesce(fv.iso_ms(F.col("fixedAt")), F.lit("(none)")).alias("fixedAt"),
    )
)

query(
    "version_audit",
    over_findings(
        'SELECT CAST(sum(n) AS BIGINT) AS log_rows, count(*) AS identities, CAST(sum(n - 1) AS BIGINT) AS superseded, '
        "count(*) FILTER (n > 1) AS collapsed_identities, count(*) FILTER (dead) AS tombstoned, "
        "count(*) FILTER (NOT dead) AS current_findings FROM "
        '(SELECT count(*) AS n, bool_or(age = 1 AND "isDeleted") AS dead FROM versions GROUP BY "findingId")'
    ),
)(lambda spark, d: versions.version_audit(findings_log(spark, d)))

query(
    "collapsed_identities",
    over_findings(
        f'SELECT "findingId", count(*) AS versions, max({iso("updatedAt")}) AS "updatedAt" '
        'FROM versions GROUP BY "findingId" HAVING count(*) > 1'
    ),
)(
    lambda spark, d: versions.collapsed_identities(findings_log(spark, d)).select(
        fv.finding_id().alias("findingId"),
        "versions",
        fv.iso_ms(F.col("updatedAt")).alias("updatedAt"),
    )
)

query(
    "merge_current",
    over_changes(
        'SELECT severity, status, count(*) AS "rows", round(sum(cvss), 4) AS cvss_sum FROM ('
        "SELECT severity, status, cvss FROM findings WHERE severity <> 'critical' AND \"findingId\" "
        'NOT IN (SELECT "findingId" FROM deletes) '
        "UNION ALL SELECT severity, status, cvss FROM upserts) GROUP BY ALL"
    ),
)(
    lambda spark, d: changed_current(spark, d)
    .groupBy("severity", "status")
    .agg(F.count("*").alias("rows"), F.round(F.sum("cvss"), 4).alias("cvss_sum"))
)


def change_set(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    current = current_findings(spark, d)
    return current, star_events.rescored(current), star_events.dismissed(current)


def changed_current(spark: SparkSession, d: str) -> DataFrame:
    current, upserts, ids = change_set(spark, d)
    new_rows, _ = streaming.apply_changes(
        current, upserts, ids, DATASET_VERSION, NOW, 1, max_changes=None
    )
    return versions.merge_current(current, new_rows)


_STAMPS = (
    "SELECT *, {now} + n + max(greatest(0, epoch_ms(\"updatedAt\") + 1 - {now}) - n) OVER "
    "(ORDER BY n ROWS UNBOUNDED PRECEDING) AS stamp FROM "
    "(SELECT *, row_number() OVER (ORDER BY \"findingId\") AS n FROM {table})"
)
_REVIVED = (
    "revived AS (SELECT * FROM versions WHERE age = 1 AND \"isDeleted\"), "
    "requested AS (SELECT \"findingId\", cvss, status, \"updatedAt\", \"firstSeenAt\" FROM upserts "
    "UNION ALL SELECT \"findingId\", cvss, status, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP) FROM revived), "
    "stamped AS (SELECT *, n + max(greatest({now}, coalesce(epoch_ms(\"updatedAt\") + 1, 0)) - n) OVER "
    "(ORDER BY n ROWS UNBOUNDED PRECEDING) AS stamp FROM "
    "(SELECT *, row_number() OVER (ORDER BY \"findingId\") AS n FROM requested))"
).format(now=NOW_MS)


@query(
    "apply_upserts",
    over_changes(
        'SELECT "findingId", cvss, status, n AS position, stamp AS updated_ms, '
        f'coalesce(epoch_ms("firstSeenAt"), {NOW_MS}) AS first_seen_ms FROM stamped',
        _REVIVED,
    ),
)
def _apply_upserts(spark: SparkSession, d: str) -> DataFrame:
    current = current_findings(spark, d)
    newest = newest_findings(spark, d)
    wanted = star_events.rescored(current).unionByName(star_events.revived(newest))
    return versions.apply_upserts(current, wanted, NOW, 1).select(
        "findingId",
        "cvss",
        "status",
        "position",
        F.unix_millis("updatedAt").alias("updated_ms"),
        F.unix_millis("firstSeenAt").alias("first_seen_ms"),
    )


@query(
    "apply_deletes",
    over_changes(
        'SELECT "findingId", severity, n AS position, stamp AS updated_ms, '
        'epoch_ms("firstSeenAt") AS first_seen_ms, 1 AS tombstone FROM stamped',
        f"stamped AS ({_STAMPS.format(now=NOW_MS, table='deletes')})",
    ),
)
def _apply_deletes(spark: SparkSession, d: str) -> DataFrame:
    current = current_findings(spark, d)
    return versions.apply_deletes(current, star_events.dismissed(current), NOW, 1).select(
        "findingId",
        "severity",
        "position",
        F.unix_millis("updatedAt").alias("updated_ms"),
        F.unix_millis("firstSeenAt").alias("first_seen_ms"),
        F.col("isDeleted").cast("int").alias("tombstone"),
    )


@query(
    "apply_changes",
    over_changes(
        "SELECT 'finding-upserted' AS type, \"findingId\" AS id, cvss, "
        "row_number() OVER (ORDER BY \"findingId\") AS seq FROM upserts UNION ALL "
        "SELECT 'finding-deleted', \"findingId\", -1.0, (SELECT count(*) FROM upserts) + "
        'row_number() OVER (ORDER BY "findingId") FROM deletes'
    ),
)
def _apply_changes(spark: SparkSession, d: str) -> DataFrame:
    current, upserts, ids = change_set(spark, d)
    _, emitted = streaming.apply_changes(
        current, upserts, ids, DATASET_VERSION, NOW, 1, max_changes=None
    )
    return emitted.select(
        "type",
        F.coalesce("finding.id", "id").alias("id"),
        F.coalesce("finding.cvss", F.lit(-1.0)).alias("cvss"),
        "seq",
    )


_USERS = 'users AS (SELECT DISTINCT md5(CAST(user_id AS VARCHAR)) AS "findingId" FROM events)'


@query(
    "unknown_deletes",
    over_changes(
        'SELECT "findingId" FROM users WHERE "findingId" NOT IN (SELECT "findingId" FROM findings)',
        _USERS,
    ),
)
def _unknown_deletes(spark: SparkSession, d: str) -> DataFrame:
    current = current_findings(spark, d)
    users = table(spark, d, "events").select(F.md5(F.col("user_id").cast("string")).alias("findingId"))
    ids = star_events.dismissed(current).select("findingId").union(users.distinct())
    return versions.unknown_deletes(current, ids)


@query(
    "lookup_previous",
    over_changes(f'SELECT "findingId", {iso("updatedAt")} AS "updatedAt", cvss FROM findings '
                 "WHERE severity = 'critical'"),
)
def _lookup_previous(spark: SparkSession, d: str) -> DataFrame:
    current, upserts, _ = change_set(spark, d)
    return versions.lookup_previous(current, upserts).select(
        "findingId", fv.iso_ms(F.col("updatedAt")).alias("updatedAt"), "cvss"
    )


@query("lookup_by_ids", over_changes('SELECT "findingId", cve, severity FROM deletes'))
def _lookup_by_ids(spark: SparkSession, d: str) -> DataFrame:
    current, _, ids = change_set(spark, d)
    return versions.lookup_by_ids(current, ids).select("findingId", "cve", "severity")


@query(
    "read_back_applied",
    over_changes('SELECT "findingId" AS "requestOrder", cvss, status, severity FROM upserts'),
)
def _read_back(spark: SparkSession, d: str) -> DataFrame:
    _, upserts, _ = change_set(spark, d)
    return versions.read_back_applied(changed_current(spark, d), upserts).select(
        "requestOrder", "cvss", "status", "severity"
    )


@query("apply_bucketed", ORACLES["merge_current"])
def _apply_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The change set in three batches on a stored table, each of which reads only the buckets it names."""
    current, upserts, ids = change_set(spark, d)
    findings = streaming.FindingsTable(spark, scratch_path(spark, "table"), DATASET_VERSION, 2, None)
    findings.create(current, NOW)
    asked = upserts.select(F.lit("upsert").alias("op"), "*", F.crc32("cve").alias("share")).unionByName(
        ids.select(F.lit("delete").alias("op"), "*", F.lit(2).cast("long").alias("share")), allowMissingColumns=True
    )
    for number, share in ((1, F.col("share") % 2 == 0), (2, F.col("share") % 2 == 1), (3, None)):
        part = F.col("op") == ("delete" if share is None else "upsert")
        batch = asked.where(part if share is None else part & share)
        findings.apply(batch.select(*streaming.CHANGE_COLUMNS), number, NOW)
    return findings.current().groupBy("severity", "status").agg(
        F.count("*").alias("rows"), F.round(F.sum("cvss"), 4).alias("cvss_sum")
    )
