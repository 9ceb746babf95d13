"""Side-by-side comparison of two analysis modes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnlake.functions.values import ordered_rank
from vulnlake.operators.facets import FACET_SIZE, facet_value
from vulnlake.operators.predicates import all_of, common_scope, filters_match, mode_matches
from vulnlake.operators.top import keys_of_lists, list_name
from vulnlake.session import write_out
from vulnlake.spec import QuerySpec

# Display order of severities and the label of a blank key.
SEVERITY_ORDER = ("critical", "high", "medium", "low", "unknown")
BLANK_LABEL = "(blank)"
COMPARED = {"severity": SEVERITY_ORDER, "kaiStatus": ()}


def _label(key: Column) -> Column:
    return F.when(key == "", BLANK_LABEL).otherwise(key)


def compare_merge(left: DataFrame, right: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Full outer merge of two (value, count) lists.

    Columns: rank (preferred keys first, then one shared rank), key, label,
    left, right, delta. Display order is rank, then key.
    """
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(F.col(s), zero) for s in ("left", "right")]
    return (
        left.select(F.col("value").alias("key"), F.col("count").alias("left"))
        .join(right.select(F.col("value").alias("key"), F.col("count").alias("right")), "key",
              "full_outer")
        .select(
            ordered_rank(F.col("key"), order).alias("rank"),
            "key",
            _label(F.col("key")).alias("label"),
            counts[0].alias("left"),
            counts[1].alias("right"),
            (counts[1] - counts[0]).alias("delta"),
        )
    )


def compare_modes(current: DataFrame, spec: QuerySpec, left: str, right: str,
                  size: int = FACET_SIZE) -> DataFrame:
    """Totals, severities and statuses of two modes as (metric, rank, key, ...).

    Both modes are counted in one scan; the search text is not applied.
    A facet keeps its `size` most frequent values per mode, like the facets do.
    The few counts are stored, as each mode ranks them for itself.
    """
    base = replace(spec, mode="all", search=None)
    scopes = {f: all_of(filters_match(base.filters, skip=f)) for f in COMPARED}
    inside = all_of(filters_match(base.filters))
    lists = {
        "total": F.when(inside, F.lit("total")),
        **{f: F.when(scopes[f], facet_value(f)) for f in COMPARED},
    }
    contributions = keys_of_lists(
        current.where(common_scope(base)),
        lists,
        keep={"in_left": mode_matches(left), "in_right": mode_matches(right)},
    )
    # An empty scope still reports its totals as zero.
    nothing = current.sparkSession.range(1).select(
        F.lit(0).alias("list_no"),
        F.lit("total").alias("key"),
        F.lit(False).alias("in_left"),
        F.lit(False).alias("in_right"),
    )
    counts = (
        contributions.unionByName(nothing)
        .groupBy("list_no", "key")
        .agg(F.count_if("in_left").alias("n_left"), F.count_if("in_right").alias("n_right"))
        .select(list_name(lists).alias("metric"), "key", "n_left", "n_right")
    )

    counts = write_out(counts, "compared")

    def place(count: str) -> Column:
        return F.row_number().over(W.partitionBy("metric").orderBy(F.desc(count), F.asc("key")))

    kept = F.col("metric") == "total"
    top_left = counts.withColumn("place", place("n_left")).where(F.col("place") <= size)
    top_right = counts.withColumn("place", place("n_right")).where(F.col("place") <= size)
    l = top_left.where(kept | (F.col("n_left") > 0)).select(
        "metric", "key", F.col("n_left").alias("left")
    )
    r = top_right.where(kept | (F.col("n_right") > 0)).select(
        "metric", "key", F.col("n_right").alias("right")
    )
    zero = F.lit(0).cast("long")
    left_count, right_count = F.coalesce("left", zero), F.coalesce("right", zero)
    rank = F.lit(1).cast("long")
    for name, order in COMPARED.items():
        rank = F.when(F.col("metric") == name, ordered_rank(F.col("key"), order)).otherwise(rank)
    return l.join(r, ["metric", "key"], "full_outer").select(
        "metric",
        rank.alias("rank"),
        "key",
        _label(F.col("key")).alias("label"),
        left_count.alias("left"),
        right_count.alias("right"),
        (right_count - left_count).alias("delta"),
    )
