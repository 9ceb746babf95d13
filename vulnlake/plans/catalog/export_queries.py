"""Exports and their jobs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.functions import values as fv
from vulnlake.operators import events, export
from vulnlake.plans.catalog.facet_queries import LEFT_SQL
from vulnlake.plans.catalog.registry import NOW, NOW_MS, on_current, query
from vulnlake.plans.relations import iso, over_findings
from vulnlake.session import scratch_path
from vulnlake.sources import star_events
from vulnlake.sources.star_schema import DATASET_VERSION, current_findings, table
from vulnlake.spec import QuerySpec

_EXPORT_SPEC = QuerySpec(filters={"severity": ("critical",)}, mode="analysis")
_EXPORT_WHERE = f"severity = 'critical' AND {LEFT_SQL}"


def _cell_sql(field: str) -> str:
    column = fields.column_of(field)
    text = (
        f"strftime(\"{column}\", '%Y-%m-%d %H:%M:%S')" if field == "publishedAt" else f'"{column}"'
    )
    cell = f"coalesce({text}, '')"
    return (
        f"CASE WHEN regexp_matches({cell}, '^[=+\\-@\\t\\r]') THEN '''' || {cell} ELSE {cell} END "
        f'AS "{field}"'
    )


_EXPORT_SQL = "SELECT " + ", ".join(
    "cvss" if f == "cvss" else _cell_sql(f) for f in fields.EXPLORE
) + f" FROM findings WHERE {_EXPORT_WHERE}"

on_current("export_count", f"SELECT count(*) AS total FROM findings WHERE {_EXPORT_WHERE}")(
    lambda current: export.export_count(current, _EXPORT_SPEC)
)
on_current("export_rows", _EXPORT_SQL)(lambda current: export.export_rows(current, _EXPORT_SPEC))


@query("export_csv", over_findings(_EXPORT_SQL))
def _export_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "export")
    export.write_csv(export.export_rows(current_findings(spark, d), _EXPORT_SPEC), path)
    schema = ", ".join(
        f"`{f}` {'double' if f in fields.NUMBERS else 'string'}" for f in fields.EXPLORE
    )
    read = spark.read.csv(path, header=True, schema=schema, escape='"')
    return read.select(
        *[F.col(f) if f in fields.NUMBERS else F.coalesce(f, F.lit("")).alias(f)
          for f in fields.EXPLORE]
    )


query(
    "formula_guard",
    "SELECT doc_id, md5(CASE WHEN regexp_matches(cell, '^[=+\\-@\\t\\r]') THEN '''' || cell ELSE cell END) AS cell_md5 "
    "FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN '=' || text WHEN lang = 'fr' THEN chr(9) || text "
    "WHEN lang = 'de' THEN '@' || text ELSE text END AS cell FROM documents)",
)(
    lambda spark, d: table(spark, d, "documents").select(
        "doc_id",
        F.md5(
            fv.formula_safe(
                F.when(F.col("lang") == "en", F.concat(F.lit("="), "text"))
                .when(F.col("lang") == "fr", F.concat(F.lit("\t"), "text"))
                .when(F.col("lang") == "de", F.concat(F.lit("@"), "text"))
                .otherwise(F.col("text"))
            )
        ).alias("cell_md5"),
    )
)


def _job_rows(spark: SparkSession, d: str) -> DataFrame:
    """A manifest: every event is a step of the export job of its user."""
    kind, at = F.col("event_type"), star_events.event_time()
    status = (
        F.when(kind.isin("signup", "view"), "PENDING")
        .when(kind == "click", "RUNNING")
        .when(kind == "error", "FAILED")
        .otherwise("READY")
    )
    id = F.concat(F.lit("job-"), F.col("user_id").cast("string"))
    ready = status == "READY"
    return table(spark, d, "events").select(
        id.alias("id"),
        status.alias("status"),
        F.when(ready, F.col("event_id")).alias("rowCount"),
        F.when(ready, F.concat(id, F.lit(".csv"))).alias("artifactName"),
        F.when(status == "FAILED", export.FAILURE_TEXT).alias("errorMessage"),
        at.alias("createdAt"),
        at.alias("updatedAt"),
        (at + F.make_interval(days=F.lit(1))).alias("expiresAt"),
        F.col("event_id").alias("step"),
        F.lit("{}").alias("request"),
    )


_JOBS_AS_OF = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)
_JOBS = """
jobs AS (
  SELECT 'job-' || user_id AS id, event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'PENDING'
    WHEN event_type = 'click' THEN 'RUNNING' WHEN event_type = 'error' THEN 'FAILED' ELSE 'READY' END AS status,
    date_trunc('millisecond', ts) + INTERVAL 1 DAY AS expires,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age
  FROM events),
open_jobs AS (SELECT * FROM jobs WHERE age = 1 AND expires > TIMESTAMP '2024-01-30 12:00:00')
"""


query(
    "export_manifest_current",
    f"""WITH {_JOBS} SELECT id, status, CASE WHEN status = 'READY' THEN event_id ELSE -1 END AS "rowCount",
    CASE WHEN status = 'READY' THEN '/api/exports/' || id END AS "downloadUrl",
    CASE WHEN status = 'FAILED' THEN 'Export could not be completed' END AS "errorMessage",
    {iso("expires")} AS "expiresAt" FROM open_jobs""",
)(
    lambda spark, d: export.export_jobs(_job_rows(spark, d), _JOBS_AS_OF).withColumns(
        {
            "rowCount": F.coalesce("rowCount", F.lit(-1).cast("long")),
            "expiresAt": fv.iso_ms(F.col("expiresAt")),
        }
    )
)

query(
    "export_unfinished",
    f"WITH {_JOBS} SELECT id FROM open_jobs WHERE status IN ('PENDING', 'RUNNING')",
)(lambda spark, d: export.unfinished_jobs(_job_rows(spark, d), _JOBS_AS_OF))

query(
    "export_ready_event",
    f"""WITH {_JOBS} SELECT '{NOW_MS}-' || (row_number() OVER (ORDER BY id) - 1) AS log_id,
    '{{"v":1,"type":"export-ready","datasetVersion":"star-1","at":"2001-12-01T00:00:00.000Z","jobId":"' || id
    || '","url":"/api/exports/' || id || '"}}' AS event FROM open_jobs WHERE status = 'READY'""",
)(
    lambda spark, d: events.encode(
        export.ready_events(
            export.export_jobs(_job_rows(spark, d), _JOBS_AS_OF), DATASET_VERSION, NOW
        )
    )
)


@query(
    "export_run",
    over_findings(
        "SELECT \"findingId\" AS id, severity, 'READY' AS status, count(*) OVER () AS \"rowCount\" "
        f"FROM findings WHERE {_EXPORT_WHERE}"
    ),
)
def _export_run(spark: SparkSession, d: str) -> DataFrame:
    """A job from its request to the rows of the file it publishes."""
    store = export.ExportStore(spark, scratch_path(spark, "exports"), max_rows=None)
    job = store.run(store.create(_EXPORT_SPEC, NOW), current_findings(spark, d), NOW)
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(
        f"{store.root}/{job['artifactName']}"
    )
    return rows.select(
        "id", "severity", F.lit(job["status"]).alias("status"), F.lit(job["rowCount"]).cast("long").alias("rowCount")
    )
