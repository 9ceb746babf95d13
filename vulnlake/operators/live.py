"""Applying change events to rows that are already shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake import fields


def patch_page(page: DataFrame, events: DataFrame) -> DataFrame:
    """Page rows after upsert and delete events; nothing is ever added.

    `page` has the explore columns. A row takes the values of its newest
    upsert; a row that any event deletes is dropped.
    """
    order = F.struct("ms", "seq")
    newest = (
        events.where(F.col("type") == "finding-upserted")
        .groupBy(F.col("finding.id").alias("id"))
        .agg(F.max_by("finding", order).alias("finding"))
    )
    deleted = events.where(F.col("type") == "finding-deleted").select("id")
    patched = [
        F.when(F.col("finding").isNotNull(), F.col(f"finding.{f}")).otherwise(F.col(f)).alias(f)
        for f in fields.EXPLORE
        if f != "id"
    ]
    others = [c for c in page.columns if c not in fields.EXPLORE]
    return (
        page.join(deleted, "id", "left_anti")
        .join(newest, "id", "left")
        .select("id", *patched, *others)
    )
