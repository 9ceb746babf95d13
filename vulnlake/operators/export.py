"""Spreadsheet-safe CSV export and its job manifest."""

from __future__ import annotations

import json
import logging
import re
import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import fields
from vulnlake.functions.values import formula_safe, text_ms, text_seconds
from vulnlake.operators.events import blank_event, next_id
from vulnlake.operators.ordered import with_running
from vulnlake.operators.paging import total_order
from vulnlake.operators.predicates import page_scope
from vulnlake.sources.tables import exists, move, remove
from vulnlake.spec import QuerySpec, Sort, TimeRange, parse_instant, utc

LOG = logging.getLogger(__name__)

# Job states, bounds and texts of the export contract.
STATUSES = ("PENDING", "RUNNING", "READY", "FAILED")
UNFINISHED = ("PENDING", "RUNNING")
MAX_ROWS = 2_147_483_647
EXPIRES_SECONDS = 3_600
FAILURE_TEXT = "Export could not be completed"
JOB_ID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rowCount", T.LongType()),
        T.StructField("artifactName", T.StringType()),
        T.StructField("errorMessage", T.StringType()),
        T.StructField("createdAt", T.TimestampType()),
        T.StructField("updatedAt", T.TimestampType()),
        T.StructField("expiresAt", T.TimestampType()),
        T.StructField("step", T.LongType()),
        T.StructField("request", T.StringType()),
    ]
)


class ExportTooLarge(RuntimeError):
    """The export would hold more rows than a job may report."""


def job_id(text: str) -> str:
    if not isinstance(text, str) or not JOB_ID.fullmatch(text):
        raise ValueError(f"not an export job id: {text!r}")
    return text


def artifact_name(id: str) -> str:
    return f"{job_id(id)}.csv"


def download_url(id: str) -> str:
    return f"/api/exports/{job_id(id)}"


def export_count(current: DataFrame, spec: QuerySpec) -> DataFrame:
    return current.where(page_scope(spec)).agg(F.count("*").alias("total"))


def checked_count(total: int, max_rows: int | None = MAX_ROWS) -> int:
    """The count of an export; the bound of the service's type can be lifted."""
    if total < 0 or (max_rows is not None and total > max_rows):
        raise ExportTooLarge(f"{total} rows are outside 0..{max_rows}")
    return total


def _cell(field: str) -> Column:
    column = F.col(fields.column_of(field))
    if field in fields.NUMBERS:
        return column.alias(field)
    if field in fields.SECOND_DATES:
        column = text_seconds(column)
    elif field in fields.DATES:
        column = text_ms(column)
    return formula_safe(column).alias(field)


def export_rows(current: DataFrame, spec: QuerySpec) -> DataFrame:
    """Every row in scope as guarded cells, in page order."""
    ordered = current.where(page_scope(spec)).orderBy(*total_order(spec.sort))
    return ordered.select(*[_cell(f) for f in fields.EXPLORE])


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV folder; its part files, in name order, hold the rows in order."""
    (
        rows.write.mode("errorifexists")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def freeze_request(spec: QuerySpec) -> str:
    """The export's scope as JSON text, with absolute time bounds."""

    def text(moment: datetime | None) -> str | None:
        if moment is None:
            return None
        return utc(moment).isoformat(timespec="milliseconds").replace("+00:00", "Z")

    return json.dumps(
        {
            "filters": {f: list(v) for f, v in spec.filters.items()},
            "timeRange": {
                "from": text(spec.time_range.start),
                "to": text(spec.time_range.end),
            },
            "analysisMode": spec.mode,
            "search": spec.search,
            "sort": {"field": spec.sort.field, "direction": spec.sort.direction},
        }
    )


def restore_request(text: str) -> QuerySpec:
    stored = json.loads(text)
    bounds = [
        None if stored["timeRange"][side] is None else parse_instant(stored["timeRange"][side])
        for side in ("from", "to")
    ]
    return QuerySpec(
        filters={f: tuple(v) for f, v in stored["filters"].items()},
        time_range=TimeRange(*bounds),
        mode=stored["analysisMode"],
        search=stored["search"],
        sort=Sort(**stored["sort"]),
    )


def newest_jobs(manifest: DataFrame) -> DataFrame:
    """Latest row per job of the append-only manifest."""
    newest = W.partitionBy("id").orderBy(F.desc("step"))
    return (
        manifest.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    )


def export_jobs(manifest: DataFrame, as_of: datetime) -> DataFrame:
    """Public job rows that have not expired; only finished jobs have a link."""
    ready = (F.col("status") == "READY") & (
        F.col("artifactName") == F.concat(F.col("id"), F.lit(".csv"))
    )
    return (
        newest_jobs(manifest)
        .where(F.col("expiresAt") > F.lit(utc(as_of)))
        .select(
            "id",
            "status",
            "rowCount",
            F.when(ready, F.concat(F.lit("/api/exports/"), F.col("id"))).alias("downloadUrl"),
            "errorMessage",
            "expiresAt",
        )
    )


def export_job(manifest: DataFrame, id: str, as_of: datetime) -> DataFrame:
    return export_jobs(manifest.where(F.col("id") == job_id(id)), as_of)


def unfinished_jobs(manifest: DataFrame, as_of: datetime) -> DataFrame:
    """Ids of jobs to take up again, in order."""
    return (
        export_jobs(manifest, as_of)
        .where(F.col("status").isin(*UNFINISHED))
        .select("id")
        .orderBy("id")
    )


def ready_events(jobs: DataFrame, dataset_version: str, at: datetime,
                 last: tuple[int, int] | None = None) -> DataFrame:
    """One export-ready event per finished job, in order of the job ids.

    Log ids follow `last`, the newest id of the log.
    """
    moment = F.lit(utc(at))
    ms, seq = next_id(at, last)
    ready = with_running(
        jobs.where(F.col("status") == "READY"), ["id"], sums={"_n": F.lit(1).cast("long")}
    )
    return ready.select(
        *blank_event(
            ms=F.lit(ms),
            seq=F.col("_n") - 1 + seq,
            type=F.lit("export-ready"),
            datasetVersion=F.lit(dataset_version),
            at=moment,
            jobId=F.col("id"),
            url=F.concat(F.lit("/api/exports/"), F.col("id")),
        )
    )


class ExportStore:
    """Export jobs below one folder: `manifest/` rows and `<id>.csv` folders."""

    def __init__(self, spark: SparkSession, root: str, expires_seconds: int = EXPIRES_SECONDS,
                 max_rows: int | None = MAX_ROWS):
        self.spark = spark
        self.max_rows = max_rows
        self.root = root.rstrip("/")
        self.expires_seconds = expires_seconds

    def manifest(self) -> DataFrame:
        if not exists(self.spark, f"{self.root}/manifest"):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).json(f"{self.root}/manifest")

    def _append(self, job: dict) -> dict:
        row = [job[f] for f in MANIFEST_SCHEMA.fieldNames()]
        self.spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(
            f"{self.root}/manifest"
        )
        return job

    def create(self, spec: QuerySpec, now: datetime) -> dict:
        now = utc(now)
        return self._append(
            {
                "id": str(uuid.uuid4()),
                "status": "PENDING",
                "rowCount": None,
                "artifactName": None,
                "errorMessage": None,
                "createdAt": now,
                "updatedAt": now,
                "expiresAt": now + timedelta(seconds=self.expires_seconds),
                "step": 0,
                "request": freeze_request(spec),
            }
        )

    def _move(self, job: dict, now: datetime, **changes) -> dict:
        return self._append({**job, **changes, "step": job["step"] + 1, "updatedAt": utc(now)})

    def newest(self, id: str) -> dict | None:
        """The latest manifest row of a job."""
        row = newest_jobs(self.manifest().where(F.col("id") == job_id(id))).first()
        if row is None:
            return None
        times = {f: utc(row[f]) for f in ("createdAt", "updatedAt", "expiresAt")}
        return {**row.asDict(), **times}

    def run(self, job: dict, current: DataFrame, now: datetime) -> dict:
        """Count, write and publish one job; a failure is recorded and logged, not raised.

        Finished and expired jobs are left as they are. The file is written to a
        folder of this attempt, so that what a lost attempt left behind does not
        matter, and then takes the job's name.
        """
        job = self.newest(job["id"]) or job
        if job["status"] not in UNFINISHED or job["expiresAt"] <= utc(now):
            return job
        job = self._move(job, now, status="RUNNING", artifactName=None, errorMessage=None)
        spec = restore_request(job["request"])
        name = artifact_name(job["id"])
        attempt = f"attempts/{uuid.uuid4()}"
        try:
            total = checked_count(export_count(current, spec).first()["total"], self.max_rows)
            job = self._move(job, now, rowCount=total)
            write_csv(export_rows(current, spec), f"{self.root}/{attempt}")
            # Nothing points to a file of that name before the job is READY.
            self._remove(name)
            move(self.spark, f"{self.root}/{attempt}", f"{self.root}/{name}")
        except Exception:
            LOG.exception("export job %s failed", job["id"])
            self._remove(attempt)
            return self._move(
                job, now, status="FAILED", artifactName=None, errorMessage=FAILURE_TEXT
            )
        return self._move(job, now, status="READY", artifactName=name)

    def _remove(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")
