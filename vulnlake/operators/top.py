"""Counts per key and the first k of each list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_counts(scoped: DataFrame, value: Column, k: int) -> DataFrame:
    """(value, count) of the k most frequent values; ties by value."""
    return (
        scoped.groupBy(value.alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("value"))
        .limit(k)
    )


def keys_of_lists(
    scoped: DataFrame,
    scalars: dict[str, Column],
    array: tuple[str, Column] | None = None,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """(list_no, key, kept columns): one row per key that a row gives to a list.

    A scalar gives one key, or none when it is NULL; the array gives each of
    its elements. The place in the exploded array tells the lists apart, so
    only the keys themselves are exploded.
    """
    keys = F.array(*scalars.values())
    if array is not None:
        keys = F.concat(keys, array[1])
    kept = [c.alias(n) for n, c in (keep or {}).items()]
    return (
        scoped.select(F.posexplode(keys).alias("pos", "key"), *kept)
        .where(F.col("key").isNotNull())
        .select(F.least("pos", F.lit(len(scalars))).alias("list_no"), "key", *(keep or {}))
    )


def list_name(scalars: dict[str, Column], array: tuple[str, Column] | None = None) -> Column:
    """Name behind `list_no`."""
    names = [*scalars, *([array[0]] if array else [])]
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("list_no") + 1)


def counts_of_lists(
    scoped: DataFrame,
    scalars: dict[str, Column],
    array: tuple[str, Column],
    list_column: str,
    key_column: str,
) -> DataFrame:
    """Counts of every key of several lists from one scan and one shuffle."""
    return (
        keys_of_lists(scoped, scalars, array)
        .groupBy("list_no", "key")
        .agg(F.count("*").alias("count"))
        .select(
            list_name(scalars, array).alias(list_column), F.col("key").alias(key_column), "count"
        )
    )


def ranked(counts: DataFrame, list_column: str, order: list[Column], k: int,
           rank_name: str = "ord") -> DataFrame:
    """First k rows per list. Map tasks keep k per list before the shuffle."""
    place = W.partitionBy(list_column).orderBy(*order)
    return counts.withColumn(rank_name, F.row_number().over(place)).where(F.col(rank_name) <= k)
