"""Nested scanner reports: reading, flattening, census and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import fields
from vulnlake.functions.values import (
    as_number,
    as_string,
    as_string_array,
    inherit,
    is_nested,
    is_object,
    is_text,
    nullable_string,
    object_keys_or_array,
    sanitize_text,
)
from vulnlake.operators.ordered import cut_ranges, running

# Fixed value: default byte budget of a sample.
SAMPLE_BYTES = 10 * 1024 * 1024

_IMAGE = T.StructType(
    [
        T.StructField("name", T.VariantType()),
        T.StructField("buildType", T.VariantType()),
        T.StructField("vulnerabilities", T.ArrayType(T.VariantType())),
    ]
)
_REPO = T.StructType(
    [
        T.StructField("name", T.VariantType()),
        T.StructField("images", T.MapType(T.StringType(), _IMAGE)),
    ]
)
_GROUP = T.StructType(
    [
        T.StructField("name", T.VariantType()),
        T.StructField("repos", T.MapType(T.StringType(), _REPO)),
    ]
)
# Subtrees that are not declared here are skipped by the reader.
CORPUS_SCHEMA = T.StructType(
    [T.StructField("groups", T.MapType(T.StringType(), _GROUP))]
)


def read_source(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per report document below `path`: (groups, corrupt, source).

    A multi-line file is one task. Large corpora are folders of many
    documents, or JSON lines (`multi_line=False`), which split freely. A
    document that cannot be read leaves its text in `corrupt`; `source` orders
    documents by file and place, however the files are split. Of repeated keys in
    an object the last counts.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    schema = T.StructType([*CORPUS_SCHEMA.fields, T.StructField("corrupt", T.StringType())])
    documents = spark.read.schema(schema).json(
        path, multiLine=multi_line, columnNameOfCorruptRecord="corrupt"
    )
    # Within a block, generated ids grow in the order of its lines.
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return documents.select("groups", "corrupt", place.alias("source"))


def parse_documents(texts: DataFrame, column: str) -> DataFrame:
    """Parse report documents held as text; the other columns are kept.

    A document that cannot be read leaves its text in `corrupt`, as `read_source` does.
    """
    others = [c for c in texts.columns if c not in (column, "corrupt")]
    schema = T.StructType([*CORPUS_SCHEMA.fields, T.StructField("corrupt", T.StringType())])
    parsed = F.from_json(column, schema, {"columnNameOfCorruptRecord": "corrupt"})
    return texts.select(*others, parsed.alias("_doc")).select(*others, "_doc.groups", "_doc.corrupt")


def _name_or_key(name: Column, key: Column) -> Column:
    """A `name` inside the object replaces its key; a null name is blank."""
    return F.when(name.isNotNull() & ~is_nested(name), as_string(name)).otherwise(key)


def _containers(corpus: DataFrame, outer: bool) -> DataFrame:
    """One row per image; with `outer`, empty groups and repos keep one row.

    groupPlace, repoPlace and imagePlace number the entries in source order.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    kept = [c for c in corpus.columns if c != "groups"]
    # An inner explode would test `groups` for entries below it, which parses a text anew for each test.
    rows = corpus.select(*kept, F.posexplode_outer("groups").alias("groupPlace", "groupKey", "g"))
    if not outer:
        rows = rows.where(F.col("groupPlace").isNotNull())
    kept += ["groupPlace", "groupKey"]
    rows = rows.select(
        *kept,
        F.col("g.name").alias("groupName"),
        explode("g.repos").alias("repoPlace", "repoKey", "r"),
    )
    kept += ["groupName", "repoPlace", "repoKey"]
    return rows.select(
        *kept,
        F.col("r.name").alias("repoName"),
        explode("r.images").alias("imagePlace", "imageKey", "i"),
    )


def flatten_source(corpus: DataFrame) -> DataFrame:
    """One row per vulnerability object.

    Columns: group, repo, image, imageBuildType, place (source order within
    the document), record, and the columns `corpus` has beside `groups` and
    `corrupt`.
    """
    others = [c for c in corpus.columns if c not in ("groups", "corrupt")]
    images = _containers(corpus, outer=False).select(
        *others,
        _name_or_key(F.col("groupName"), F.col("groupKey")).alias("group"),
        _name_or_key(F.col("repoName"), F.col("repoKey")).alias("repo"),
        _name_or_key(F.col("i.name"), F.col("imageKey")).alias("image"),
        F.when(F.col("i.buildType").isNotNull(), as_string(F.col("i.buildType")))
        .otherwise("")
        .alias("imageBuildType"),
        "groupPlace",
        "repoPlace",
        "imagePlace",
        F.posexplode("i.vulnerabilities").alias("recordPlace", "record"),
    )
    return images.where(is_object(F.col("record"))).select(
        *others,
        "group",
        "repo",
        "image",
        "imageBuildType",
        F.struct("groupPlace", "repoPlace", "imagePlace", "recordPlace").alias("place"),
        "record",
    )


_RAW_RECORD = (
    "struct<"
    + ",".join(f"`{f}`:variant" for f in fields.SOURCE_FIELDS if f not in fields.CONTEXT_STRINGS)
    + ">"
)


def normalized(field: str) -> Column:
    """Source column of one finding field, from `_raw` members and the context."""
    if field in fields.CONTEXT_STRINGS:
        return F.col(field)
    value = F.col(f"_raw.{field}")
    if field == "buildType":
        return inherit(value, F.col("imageBuildType"))
    if field in fields.NUMBERS:
        return as_number(value)
    if field in fields.NULLABLE_STRINGS:
        return nullable_string(value)
    if field == "riskFactors":
        return object_keys_or_array(value)
    if field in fields.STRING_ARRAYS:
        return as_string_array(value)
    return as_string(value)


def normalize(records: DataFrame) -> DataFrame:
    """The 26 finding columns of flattened records, other columns kept."""
    context = {"group", "repo", "image", "imageBuildType", "record"}
    others = [c for c in records.columns if c not in context]
    members = records.withColumn("_raw", F.try_variant_get("record", "$", _RAW_RECORD))
    return members.select(*[normalized(f).alias(f) for f in fields.SOURCE_FIELDS], *others)


def _record_count() -> Column:
    """Objects in an image's array; NULL without an array."""
    return F.size(F.filter("i.vulnerabilities", is_object))


def census(corpus: DataFrame) -> DataFrame:
    """One row of distinct containers, vulnerability arrays and records."""
    images = _containers(corpus, outer=True).select(
        "groupKey",
        "repoKey",
        "imageKey",
        F.when(is_text(F.col("i.name")), as_string(F.col("i.name"))).alias("name"),
        _record_count().alias("records"),
    )
    # Fold documents that describe one image before counting distinct levels.
    per_image = images.groupBy("groupKey", "repoKey", "imageKey", "name").agg(
        F.count_if(F.col("records") >= 0).alias("arrays"),
        F.count_if(F.col("records") > 0).alias("filled"),
        F.sum(F.greatest("records", F.lit(0)).cast("long")).alias("records"),
    )
    level = F.array_compact(
        F.array(
            F.when(F.col("groupKey").isNotNull(), F.struct(
                F.lit("group").alias("level"), F.array("groupKey").alias("key"))),
            F.when(F.col("repoKey").isNotNull(), F.struct(
                F.lit("repo").alias("level"), F.array("groupKey", "repoKey").alias("key"))),
            F.when(F.col("imageKey").isNotNull(), F.struct(
                F.lit("image").alias("level"),
                F.array("groupKey", "repoKey", "imageKey").alias("key"))),
            F.when(F.col("name").isNotNull(), F.struct(
                F.lit("name").alias("level"), F.array("name").alias("key"))),
            F.struct(F.lit("counts").alias("level"), F.array(F.lit("")).alias("key")),
        )
    )
    keys = (
        per_image.select(F.explode(level).alias("l"), "arrays", "filled", "records")
        .groupBy("l")
        .agg(*[F.sum(c).alias(c) for c in ("arrays", "filled", "records")])
    )

    def count_of(name: str) -> Column:
        return F.count_if(F.col("l.level") == name)

    def sum_of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("l.level") == "counts", F.col(name))), F.lit(0))

    return keys.agg(
        count_of("group").alias("groups"),
        count_of("repo").alias("repos"),
        count_of("image").alias("imageKeys"),
        count_of("name").alias("imageNames"),
        sum_of("arrays").alias("vulnArrays"),
        sum_of("filled").alias("nonEmptyVulnArrays"),
        sum_of("records").alias("vulnTotal"),
    )


def group_sizes(corpus: DataFrame) -> DataFrame:
    """(groupKey, records) with empty groups kept."""
    return (
        _containers(corpus, outer=True)
        .where(F.col("groupKey").isNotNull())
        .groupBy("groupKey")
        .agg(F.sum(F.greatest(_record_count(), F.lit(0)).cast("long")).alias("records"))
    )


def empty_groups(corpus: DataFrame) -> DataFrame:
    """(groups, groupKey): every empty group beside the number of all groups."""
    sizes = group_sizes(corpus)
    total = sizes.agg(F.count("*")).scalar()
    return sizes.where(F.col("records") == 0).select(total.alias("groups"), "groupKey")


def record_bytes(rows: DataFrame) -> Column:
    return F.octet_length(F.to_json(F.struct(*rows.columns)))


def sample_prefix(rows: DataFrame, order_by: list[str], budget: int = SAMPLE_BYTES,
                  size: Column | None = None) -> DataFrame:
    """Rows of a total order up to a byte budget, whole rows only.

    The row that reaches the budget is the last one. Adds `bytes`. Only the
    order columns and sizes are put in order, and of these only ranges that begin
    within the budget are summed row by row; the rows themselves are filtered
    by the last key that still fits. Sizes are not negative.
    """
    sized = rows.withColumn(
        "bytes", (record_bytes(rows) if size is None else size).cast("long")
    )
    through = running(
        cut_ranges(sized.select(*order_by, "bytes"), order_by),
        order_by,
        sums={"_through": F.col("bytes")},
        ranges=F.coalesce("_before__through", F.lit(0)) < budget,
    )
    key = F.struct(*order_by)
    last = through.where(F.col("_through") - F.col("bytes") < budget).agg(F.max(key))
    return sized.where(key <= last.scalar())


def sample_manifest(sample: DataFrame) -> DataFrame:
    return sample.agg(
        F.count("*").alias("sourceRows"),
        F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("approxBytes"),
    )


def sanitize(rows: DataFrame, replacements: dict[str, str]) -> DataFrame:
    """Apply text replacements to every string and string-array column."""

    def clean(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            column = sanitize_text(column, replacements)
        elif field.dataType.simpleString() == "array<string>":
            column = F.transform(column, lambda e: sanitize_text(e, replacements))
        return column.alias(field.name)

    return rows.select(*[clean(f) for f in rows.schema.fields])


def sanitize_documents(texts: DataFrame, column: str, replacements: dict[str, str]) -> DataFrame:
    """Apply replacements to documents held as text, keys included."""
    return texts.withColumn(column, sanitize_text(F.col(column), replacements))
