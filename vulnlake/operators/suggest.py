"""Prefix suggestions over the searchable columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.functions.values import ordered_rank
from vulnlake.operators.predicates import prefix_matches
from vulnlake.operators.top import keys_of_lists, list_name, ranked
from vulnlake.spec import suggestion_arguments

# Public names of the searchable fields.
FIELD_LABELS = {
    "cve": "CVE",
    "packageName": "PACKAGE_NAME",
    "image": "IMAGE",
    "repo": "REPO",
}


def distinct_values(current: DataFrame, field: str, prefix: str) -> DataFrame:
    """Distinct non-blank values of one column that start with the prefix."""
    return (
        current.where(prefix_matches(field, prefix)).select(F.col(field).alias("value")).distinct()
    )


def suggest_candidates(current: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """(field, value, place): per column the shortest matches in bytes, then by value."""
    prefix, limit = suggestion_arguments(prefix, limit)
    matches = {f: F.when(prefix_matches(f, prefix), F.col(f)) for f in fields.SEARCHABLE}
    distinct = (
        keys_of_lists(current, matches)
        .distinct()
        .select(list_name(matches).alias("field"), F.col("key").alias("value"))
    )
    return ranked(distinct, "field", [F.octet_length("value"), F.col("value")], limit, "place")


def rank_suggestions(candidates: DataFrame, limit: int) -> DataFrame:
    """(ord, field, value): a fair share per field, then the rest in field order.

    `candidates` is bounded by `limit` rows per field and ordered by `place`.
    """
    share = max(1, limit // len(fields.SEARCHABLE))
    field_place = ordered_rank(F.col("field"), fields.SEARCHABLE)
    first = candidates.groupBy("field", "value").agg(F.min("place").alias("place"))
    in_field = W.partitionBy("field").orderBy("place")
    placed = first.withColumn("n", F.row_number().over(in_field))
    order = [F.col("n") > share, field_place, F.col("n")]
    labels = F.create_map(*[F.lit(x) for item in FIELD_LABELS.items() for x in item])
    return (
        placed.withColumn("ord", F.row_number().over(W.orderBy(*order)).cast("long"))
        .where(F.col("ord") <= limit)
        .select("ord", F.element_at(labels, F.col("field")).alias("field"), "value")
    )


def suggest(current: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    prefix, limit = suggestion_arguments(prefix, limit)
    return rank_suggestions(suggest_candidates(current, prefix, limit), limit)
