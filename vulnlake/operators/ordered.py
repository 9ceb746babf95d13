"""Running totals over one total order, without one task seeing every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnlake.session import write_out


def cut_ranges(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Rows cut into ranges of the order, with the range number in `_slice`.

    Range bounds come from a sample, so the cut is written to shared storage:
    a repeated task must see the ranges the totals were made from.
    """
    return write_out(
        df.repartitionByRange(*order_by).withColumn("_slice", F.spark_partition_id()), "ordered"
    )


def running(
    sliced: DataFrame,
    order_by: list[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    ranges: Column | None = None,
) -> DataFrame:
    """Add running sums and maxima over cut ranges, current row included.

    Each range is totalled, the few totals are accumulated, and every range
    runs its own window on top of what came before it. With `ranges`, a condition
    on `_before_<name>` (NULL in the first range), rows of other ranges are left
    out before they are shuffled.
    """
    sums, maxima = sums or {}, maxima or {}
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # One row per range: as many as the range exchange has partitions.
    carried = (
        sliced.groupBy("_slice")
        .agg(
            *[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()],
            *[F.max(c).alias(f"_of_{n}") for n, c in maxima.items()],
        )
        .select(
            "_slice",
            *[F.sum(f"_of_{n}").over(before).alias(f"_before_{n}") for n in sums],
            *[F.max(f"_of_{n}").over(before).alias(f"_before_{n}") for n in maxima],
        )
    )
    if ranges is not None:
        carried = carried.where(ranges)
    inside = (
        W.partitionBy("_slice").orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    totals = [
        (F.coalesce(F.col(f"_before_{n}"), F.lit(0)) + F.sum(c).over(inside)).alias(n)
        for n, c in sums.items()
    ] + [
        F.greatest(F.col(f"_before_{n}"), F.max(c).over(inside)).alias(n)
        for n, c in maxima.items()
    ]
    return sliced.join(F.broadcast(carried), "_slice").select(*sliced.columns, *totals)


def with_running(
    df: DataFrame,
    order_by: list[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums and maxima of `df` over a total order."""
    return running(cut_ranges(df, order_by), order_by, sums, maxima).drop("_slice")


def placed(df: DataFrame) -> DataFrame:
    """Rows written with their read partition and the place in it in `_id`, for `number_rows`."""
    return write_out(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Number rows 1, 2, 3 in the order Spark reads them, without a shuffle.

    The generated id holds the read partition and the place in it; adding up
    the sizes of the partitions before it makes the numbers dense. Rows of
    `placed` are not written again and lose their `_id`.
    """
    rows = df if "_id" in df.columns else placed(df)
    part = F.shiftright("_id", 33)
    # One row per read partition.
    before = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).select(
        "_part",
        F.coalesce(
            F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    number = F.col("_id") - F.shiftleft("_part", 33) + F.col("_before") + 1
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .select(*[c for c in df.columns if c != "_id"], number.alias(name))
    )
