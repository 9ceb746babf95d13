import os
import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vulnlake import fields  # noqa: E402
from vulnlake.operators.versions import derive  # noqa: E402

T0 = datetime(2024, 6, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("vulnlake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def source_row(**changes):
    """One normalised source row with defaults."""
    row = {f: "" for f in fields.SOURCE_FIELDS}
    row.update(
        cvss=0.0, kaiStatus=None, riskFactors=[], applicableRules=[], group="g", repo="r",
        image="i", cve="CVE-1", packageName="p", packageVersion="1", severity="high",
    )
    row.update(changes)
    return row


@pytest.fixture(scope="session")
def source_rows(spark):
    def build(*changes):
        return spark.createDataFrame(
            [tuple(source_row(**c)[f] for f in fields.SOURCE_FIELDS) for c in changes],
            fields.SOURCE_SCHEMA,
        )

    return build


@pytest.fixture(scope="session")
def log_rows(spark):
    """Log rows from source changes plus (ms, batch, position, isDeleted)."""

    def build(*entries):
        rows = []
        for entry in entries:
            entry = dict(entry)
            ms = entry.pop("ms", 0)
            first = entry.pop("first", ms)
            tail = (ms, first, entry.pop("batch", 1), entry.pop("position", 0),
                    entry.pop("isDeleted", False))
            rows.append(tuple(source_row(**entry)[f] for f in fields.SOURCE_FIELDS) + tail)
        names = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in fields.SOURCE_SCHEMA.fields
        )
        raw = spark.createDataFrame(
            rows, f"{names}, ms long, first long, batch long, position long, isDeleted boolean"
        )
        stamped = raw.select(
            *fields.SOURCE_FIELDS,
            F.timestamp_millis("ms").alias("updatedAt"),
            F.timestamp_millis("first").alias("firstSeenAt"),
            "isDeleted",
            "batch",
            "position",
        )
        return derive(stamped).select(*fields.LOG_COLUMNS)

    return build
