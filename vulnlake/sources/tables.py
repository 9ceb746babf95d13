"""Tables on storage: the version log, current findings and the event log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import fields
from vulnlake.operators.versions import IDENTITY, ContractViolation, collapse_current
from vulnlake.session import brief_shuffles, small_scans, small_tasks

EVENT_LOG_SCHEMA = T.StructType(
    [T.StructField("log_id", T.StringType()), T.StructField("event", T.StringType())]
)

#: Bloom filters as large as a file's ids need; a file's filter has a megabyte otherwise.
_BLOOM = {"parquet.bloom.filter.enabled#findingId": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Buckets up to which every task writes a file of its own into each; rows of more are shuffled to them.
LOCAL_BUCKETS = 64

#: Names the folders of tombstones and of other rows.
_DEAD = "tombstone"


class TableNotEmpty(RuntimeError):
    """An initial load met existing findings."""


class ConcurrentLoad(RuntimeError):
    """Another load was published after this one began."""


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop_path = _file_system(spark, path)
    return system.exists(hadoop_path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; empty when it does not exist."""
    system, hadoop_path = _file_system(spark, path)
    if not system.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in system.listStatus(hadoop_path)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; a missing one is no error."""
    system, hadoop_path = _file_system(spark, path)
    system.delete(hadoop_path, True)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder to a name that is free."""
    system, hadoop_path = _file_system(spark, path)
    if not system.rename(hadoop_path, _file_system(spark, target)[1]):
        raise OSError(f"cannot rename {path} to {target}")


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file in one step; false when it is already there.

    Of several writers one succeeds. A writer that dies between creating the file and
    filling it leaves it empty, which readers take for no file.
    """
    system, hadoop_path = _file_system(spark, path)
    if system.getScheme() == "file":
        system.mkdirs(hadoop_path.getParent())
        try:
            with open(hadoop_path.toUri().getPath(), "x", encoding="utf-8") as file:
                file.write(text)
        except FileExistsError:
            return False
        return True
    if system.exists(hadoop_path):
        return False
    try:
        stream = system.create(hadoop_path, False)
    except Exception:
        if system.exists(hadoop_path):  # another writer was first
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over one that is there."""
    system, hadoop_path = _file_system(spark, path)
    stream = system.create(hadoop_path, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file; empty when there is none."""
    system, hadoop_path = _file_system(spark, path)
    if not system.exists(hadoop_path):
        return ""
    stream = system.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class Generations:
    """Whole contents of a root, of which the newest published one counts.

    `generation/<name>` holds a content, `commits/<n>` names the dataset version and the
    content that commit n made current. A load fills a generation that nobody reads, checks
    it, and publishes it by creating the next commit. So readers see all of a load or none
    of it, a refused or crashed load changes nothing, and of two loads that began on the same
    commit one is refused.
    """

    #: Published contents of a dataset version that are kept, for readers of the one before.
    KEPT = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self) -> list[tuple[int, dict]]:
        """Commits from the newest to the oldest; unfinished ones name nothing."""
        names = children(self.spark, f"{self.root}/commits")
        numbers = sorted((int(n) for n in names if n.isdigit()), reverse=True)
        read = ((n, read_small(self.spark, f"{self.root}/commits/{n}")) for n in numbers)
        return [(n, json.loads(text) if text else {}) for n, text in read]

    def published(self, dataset_version: str) -> str | None:
        """Folder of the content that counts, if there is one."""
        for _, commit in self._commits():
            if commit.get("datasetVersion") == dataset_version:
                return f"{self.root}/generation/{commit['generation']}"
        return None

    def begin(self) -> str:
        """A fresh folder for a load that begins on the newest commit."""
        newest = max((n for n, _ in self._commits()), default=0)
        return f"{self.root}/generation/{newest}-{uuid.uuid4().hex}"

    def publish(self, folder: str, dataset_version: str) -> None:
        """Make a folder of `begin` the content of a dataset version."""
        name = folder.rsplit("/", 1)[1]
        number = int(name.split("-")[0]) + 1
        text = json.dumps({"generation": name, "datasetVersion": dataset_version})
        if not put_if_absent(self.spark, f"{self.root}/commits/{number}", text):
            raise ConcurrentLoad(f"commit {number} of {self.root} was made by another load")
        self._sweep()

    def discard(self, folder: str) -> None:
        remove(self.spark, folder)

    def _sweep(self) -> None:
        """Delete contents that no reader needs: replaced ones and those that can never be published."""
        commits = self._commits()
        kept: dict[str, list[str]] = {}
        for _, commit in commits:
            if commit and len(kept.setdefault(commit["datasetVersion"], [])) < self.KEPT:
                kept[commit["datasetVersion"]].append(commit["generation"])
        needed = {name for names in kept.values() for name in names}
        for name in children(self.spark, f"{self.root}/generation"):
            if name not in needed and int(name.split("-")[0]) < commits[0][0]:
                self.discard(f"{self.root}/generation/{name}")


def load_initial(rows: DataFrame, path: str, dataset_version: str, replace: bool = False) -> None:
    """First load of the version log; refuses a log with current findings unless replacing.

    The new log counts in one step once it is whole; a load that is refused or fails leaves
    the old one as it was. A load without rows empties the version.
    """
    spark = rows.sparkSession
    generations = Generations(spark, path)
    folder = generations.begin()
    if not replace and generations.published(dataset_version):
        if _populated(read_log(spark, path, dataset_version)):
            raise TableNotEmpty("findings already exist; replace them explicitly")
    try:
        _write_version(rows, folder, dataset_version)
        generations.publish(folder, dataset_version)
    except BaseException:
        generations.discard(folder)
        raise


def _populated(log: DataFrame) -> bool:
    """Whether a log has current findings; collapsed only if a scan does not tell.

    Without tombstones every live row has a current finding, and the newest row of all is
    the newest of its finding.
    """
    dead = F.col("isDeleted")
    told = log.agg(
        F.count_if(~dead).alias("live"),
        F.count_if(F.coalesce(dead, F.lit(True))).alias("dead"),
        F.max_by(dead, F.struct("updatedAt", "batch", "position")).alias("last"),
    ).first()
    if not told.live or not told.dead or told.last is False:
        return told.live > 0
    return not collapse_current(log).isEmpty()


def write_log(rows: DataFrame, path: str, dataset_version: str) -> None:
    """Add log rows to one dataset version."""
    generations = Generations(rows.sparkSession, path)
    folder = generations.published(dataset_version)
    if folder is None:
        load_initial(rows, path, dataset_version)
    else:
        _write_version(rows, folder, dataset_version)


def _write_version(rows: DataFrame, folder: str, dataset_version: str) -> None:
    with brief_shuffles(rows.sparkSession):
        (
            rows.select(*fields.LOG_COLUMNS)
            .withColumn("dataset_version", F.lit(dataset_version))
            .write.mode("append")
            .option("compression", "zstd")
            .partitionBy("dataset_version")
            .parquet(folder)
        )


def read_log(spark: SparkSession, path: str, dataset_version: str) -> DataFrame:
    folder = Generations(spark, path).published(dataset_version)
    if folder is None:
        return spark.createDataFrame([], fields.LOG_SCHEMA)
    schema = T.StructType(
        list(fields.LOG_SCHEMA.fields) + [T.StructField("dataset_version", T.StringType())]
    )
    return (
        spark.read.schema(schema)
        .parquet(folder)
        .where(F.col("dataset_version") == dataset_version)
        .drop("dataset_version")
    )


def write_current(current: DataFrame, path: str, mode: str = "errorifexists",
                  finish: Callable[[DataFrame], DataFrame] | None = None, tombstones: bool = False) -> None:
    """Current findings, each file sorted by identity so that its pages prune by it.

    Rows stay in the task that collapsed them. `finish` makes the log's columns of sorted
    rows that have only the identity and what the other columns are made of, so that
    shuffles and sorts move less. With `tombstones` these may be among the rows; they get
    folders of their own, for `read_newest`.
    """
    rows = current if finish else current.select(*fields.LOG_COLUMNS)
    rows = rows.sortWithinPartitions(*(["isDeleted"] if tombstones else []), *IDENTITY)
    rows = (finish(rows) if finish else rows).select(*fields.LOG_COLUMNS)
    if tombstones:
        rows = rows.withColumn(_DEAD, F.col("isDeleted"))
    with brief_shuffles(current.sparkSession), small_tasks(current.sparkSession):
        (
            rows.write.mode(mode)
            .options(**_BLOOM)
            .option("compression", "zstd")
            .partitionBy(*([_DEAD] if tombstones else []))
            .parquet(path)
        )


def read_newest(spark: SparkSession, path: str, live: bool = False) -> DataFrame:
    """Newest versions that `write_current` wrote with their tombstones; with `live`, the others only."""
    schema = T.StructType([*fields.LOG_SCHEMA.fields, T.StructField(_DEAD, T.BooleanType())])
    rows = spark.read.schema(schema).parquet(path)
    return (rows.where(~F.col(_DEAD)) if live else rows).drop(_DEAD)


def bucket_of(finding_id: Column, buckets: int) -> Column:
    """Bucket of a finding, from the leading digits of its id, which is a hash of its identity."""
    return F.coalesce(F.conv(F.substring(finding_id, 1, 8), 16, 10).try_cast("long"), F.lit(0)) % buckets


def write_buckets(current: DataFrame, path: str, buckets: int) -> list[int]:
    """Current findings in one folder per bucket, its files sorted by identity; gives the buckets with rows.

    Rows go to few buckets from the task that reads them, without a shuffle of the whole table.
    """
    rows = current.select(*fields.LOG_COLUMNS).withColumn("bucket", bucket_of(F.col("findingId"), buckets))
    if buckets > LOCAL_BUCKETS:
        rows = rows.repartitionByRange("bucket", *IDENTITY)
    with brief_shuffles(current.sparkSession), small_scans(current.sparkSession):
        (
            rows.sortWithinPartitions("bucket", *IDENTITY)
            .write.mode("overwrite")
            .options(**_BLOOM)
            .option("compression", "zstd")
            .partitionBy("bucket")
            .parquet(path)
        )
    names = children(current.sparkSession, path)
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def read_current(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(fields.LOG_SCHEMA).parquet(*paths)


def write_events(entries: DataFrame, path: str, mode: str = "append",
                 compression: str | None = None) -> None:
    """Add (log_id, event) entries to the event log as JSON lines, which readers may find compressed."""
    with brief_shuffles(entries.sparkSession):
        entries.select("log_id", "event").write.mode(mode).json(path, compression=compression)


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of the event log; order them by their log id."""
    return spark.read.schema(EVENT_LOG_SCHEMA).json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_LOG_SCHEMA).json(path)


def ingest_report(source: DataFrame, current: DataFrame, expected_rows: int | None = None,
                  expected_findings: int | None = None) -> DataFrame:
    """One row: batches and rows written, current findings, expectations met."""
    written = source.groupBy("batch").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("batchesWritten"),
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("sourceRowsWritten"),
    )
    report = written.select(
        "*", current.agg(F.count("*")).scalar().alias("currentFindings")
    )
    return report.select(
        "*",
        F.coalesce(
            F.col("sourceRowsWritten") == F.lit(expected_rows).cast("long"), F.lit(True)
        ).alias("rowsAsExpected"),
        F.coalesce(
            F.col("currentFindings") == F.lit(expected_findings).cast("long"), F.lit(True)
        ).alias("findingsAsExpected"),
    )


def require_expected(report: DataFrame) -> None:
    """Fail when an ingest report misses its expectations or holds no batch."""
    row = report.first()
    if row.batchesWritten == 0:
        raise ContractViolation("at least one batch is required")
    if not (row.rowsAsExpected and row.findingsAsExpected):
        raise ContractViolation(f"unexpected ingest result: {row.asDict()}")

