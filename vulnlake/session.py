"""Shared storage for intermediate tables, taken from the session's settings."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_scratch_roots: set[str] = set()
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor reaches: `spark.checkpoint.dir` of the session.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.conf.get("spark.app.id", "local")
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="vulnlake-")
    return _local_dirs[application]


def _scratch_root(spark: SparkSession) -> str:
    """The application's own folder, removed when its driver ends."""
    application = spark.conf.get("spark.app.id", "local")
    root = f"{shared_dir(spark)}/vulnlake-{application}"
    if root not in _scratch_roots:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _scratch_roots.add(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's folder."""
    path = f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in getattr(_scopes, "open", ()):
        paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession, failed_too: bool = True) -> Iterator[None]:
    """Delete at its end what this thread writes to scratch inside; if it fails, only with `failed_too`."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    paths: list[str] = []
    _scopes.open.append(paths)
    done = False
    try:
        yield
        done = True
    finally:
        # By identity: scopes that hold equal paths are not the same.
        _scopes.open = [some for some in _scopes.open if some is not paths]
        context = spark.sparkContext
        for name in paths if done or failed_too else ():
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Whether the shuffle files of an action are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Shuffled bytes that one task reads, where the session's partitions allow it.
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Bytes of files that one task reads at most.
_SCANNED = "spark.sql.files.maxPartitionBytes"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def brief_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Delete the shuffle files of writes inside as soon as each one ends.

    A written table is read from its files, so nothing asks for them again; without this
    they stay on disk until the driver happens to collect garbage.
    """
    return _setting(spark, _CLEANUP, "true")


def small_tasks(spark: SparkSession) -> AbstractContextManager[None]:
    """Give a task a few MB of shuffled rows, for rows that grow much wider after the shuffle."""
    return _setting(spark, _ADVISORY, "16m")


def small_scans(spark: SparkSession) -> AbstractContextManager[None]:
    """Give a task some MB of packed files, whose rows it can sort in memory."""
    return _setting(spark, _SCANNED, "32m")


def write_out(df: DataFrame, label: str) -> DataFrame:
    """Write a table to shared storage and read it back.

    Cuts the lineage: later jobs, and tasks repeated after an executor loss,
    start from the files.
    """
    path = scratch_path(df.sparkSession, label)
    with brief_shuffles(df.sparkSession):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_out_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """As `write_out`; scratch tables that `make` writes on its way are deleted after it.

    They stay if it fails, since an error may name the rows of one.
    """
    path = scratch_path(spark, label)
    with scratch_scope(spark, failed_too=False), brief_shuffles(spark):
        df = make()
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
