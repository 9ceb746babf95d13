"""One registry of the finding columns that every other module reads."""

from __future__ import annotations

from pyspark.sql import types as T

# Public field names, groups and defaults of the data model.

IDENTITY = ("group", "repo", "image", "cve", "packageName", "packageVersion", "path")

CONTEXT_STRINGS = ("group", "repo", "image")

TEXTS = (
    "cve",
    "packageName",
    "packageVersion",
    "path",
    "description",
    "cause",
    "exploit",
    "fixDate",
    "published",
    "layerTime",
    "link",
    "owner",
    "vecStr",
    "severity",
    "packageType",
    "status",
    "advisoryType",
    "buildType",
    "type",
)

NUMBERS = ("cvss",)
NULLABLE_STRINGS = ("kaiStatus",)
STRING_ARRAYS = ("riskFactors", "applicableRules")

SOURCE_FIELDS = (
    CONTEXT_STRINGS
    + TEXTS
    + NUMBERS
    + NULLABLE_STRINGS
    + STRING_ARRAYS
)

EXPLORE = (
    "id",
    "cve",
    "severity",
    "cvss",
    "status",
    "packageName",
    "packageVersion",
    "group",
    "repo",
    "image",
    "kaiStatus",
    "publishedAt",
)

DETAIL = (
    "id",
    "group",
    "repo",
    "image",
    "cve",
    "severity",
    "cvss",
    "status",
    "packageName",
    "packageVersion",
    "packageType",
    "path",
    "advisoryType",
    "buildType",
    "type",
    "description",
    "cause",
    "exploit",
    "fixDate",
    "published",
    "layerTime",
    "link",
    "owner",
    "vecStr",
    "kaiStatus",
    "riskFactors",
    "applicableRules",
    "publishedAt",
    "fixedAt",
    "updatedAt",
)

FILTERABLE = (
    "severity",
    "status",
    "group",
    "repo",
    "image",
    "packageType",
    "advisoryType",
    "kaiStatus",
    "riskFactors",
)

SORTABLE = (
    "cvss",
    "severity",
    "cve",
    "publishedAt",
    "fixedAt",
    "packageName",
    "repo",
    "updatedAt",
)

SEARCHABLE = ("cve", "packageName", "image", "repo")

NULLABLE_SORTS = frozenset({"publishedAt", "fixedAt"})
SECOND_DATES = frozenset({"publishedAt", "fixedAt"})
DATES = frozenset({"publishedAt", "fixedAt", "updatedAt"})

ANALYSIS_EXCLUSIONS = {
    "all": None,
    "analysis": "invalid - norisk",
    "aiAnalysis": "ai-invalid-norisk",
}

FIXED_STATUS_PREFIX = "fixed"
HAS_FIX_FACTOR = "Has fix"

FINDING_ID_PATTERN = r"^[0-9a-f]{32}$"


def column_of(field: str) -> str:
    """Stored column behind a public field."""
    return "findingId" if field == "id" else field


def _source_type(field: str) -> T.DataType:
    if field in NUMBERS:
        return T.DoubleType()
    if field in STRING_ARRAYS:
        return T.ArrayType(T.StringType(), containsNull=False)
    return T.StringType()


SOURCE_SCHEMA = T.StructType(
    [T.StructField(f, _source_type(f), f in NULLABLE_STRINGS) for f in SOURCE_FIELDS]
)

# `batch` and `position` order row versions that share one `updatedAt`.
VERSION_COLUMNS = ("updatedAt", "firstSeenAt", "isDeleted", "batch", "position")
DERIVED_COLUMNS = ("findingId", "publishedAt", "fixedAt")

LOG_SCHEMA = T.StructType(
    list(SOURCE_SCHEMA.fields)
    + [
        T.StructField("findingId", T.StringType(), False),
        T.StructField("publishedAt", T.TimestampType()),
        T.StructField("fixedAt", T.TimestampType()),
        T.StructField("updatedAt", T.TimestampType(), False),
        T.StructField("firstSeenAt", T.TimestampType(), False),
        T.StructField("isDeleted", T.BooleanType(), False),
        T.StructField("batch", T.LongType(), False),
        T.StructField("position", T.LongType(), False),
    ]
)
LOG_COLUMNS = tuple(LOG_SCHEMA.fieldNames())
