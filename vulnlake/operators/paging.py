"""Total order, keyset pages, cursors and bounded results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.functions.values import text_ms, text_seconds
from vulnlake.operators.predicates import page_scope
from vulnlake.operators.rows import public_column
from vulnlake.spec import Cursor, QuerySpec, Sort


@dataclass(frozen=True)
class Page:
    """A fetched page: explore rows with their cursors, and how to go on."""

    rows: list[Row]
    end_cursor: str | None
    has_next_page: bool


class ResultTooLarge(RuntimeError):
    """A result holds more rows than its declared bound."""


def total_order(sort: Sort) -> list[Column]:
    """Sort column with NULLs last in both directions, then id ascending."""
    column = F.col(sort.field)
    first = column.asc_nulls_last() if sort.direction == "asc" else column.desc_nulls_last()
    return [first, F.col("findingId").asc()]


def _sort_literal(sort: Sort, value: str | float) -> Column:
    if sort.field in fields.DATES:
        moment = datetime.fromisoformat(value).replace(tzinfo=timezone.utc)
        return F.lit(moment)
    return F.lit(value)


def keyset_after(sort: Sort, cursor: Cursor) -> Column:
    """Rows strictly after the cursor in the total order."""
    column, ids = F.col(sort.field), F.col("findingId")
    if cursor.value is None:
        return column.isNull() & (ids > cursor.id)
    value = _sort_literal(sort, cursor.value)
    beyond = column > value if sort.direction == "asc" else column < value
    after = beyond | ((column == value) & (ids > cursor.id))
    return after | column.isNull() if sort.field in fields.NULLABLE_SORTS else after


def cursor_token(sort: Sort) -> Column:
    """URL-safe token from the sort value and the id of each row."""
    value = F.col(sort.field)
    if sort.field in fields.SECOND_DATES:
        value = text_seconds(value)
    elif sort.field in fields.DATES:
        value = text_ms(value)
    payload = F.to_json(
        F.struct(value.alias("s"), F.col("findingId").alias("id")), {"ignoreNullFields": "false"}
    )
    return F.rtrim(
        F.translate(F.base64(F.encode(payload, "UTF-8")), "+/\r\n", "-_"), F.lit("=")
    )


def page_rows(current: DataFrame, spec: QuerySpec) -> DataFrame:
    """The first `spec.first` + 1 matching rows after the cursor, in order."""
    scoped = current.where(page_scope(spec))
    if spec.cursor is not None:
        scoped = scoped.where(keyset_after(spec.sort, spec.cursor))
    order = total_order(spec.sort)
    needed = {fields.column_of(f) for f in fields.EXPLORE} | {spec.sort.field}
    return scoped.select(*sorted(needed)).orderBy(*order).limit(spec.first + 1)


def page(current: DataFrame, spec: QuerySpec) -> DataFrame:
    """One page: explore columns, `position`, `cursor` and `hasNextPage`.

    The windows run over at most `spec.first` + 1 (201) rows.
    """
    place = W.orderBy(*total_order(spec.sort))
    everything = W.partitionBy()
    return (
        page_rows(current, spec)
        .select(
            F.row_number().over(place).cast("long").alias("position"),
            *[public_column(f) for f in fields.EXPLORE],
            cursor_token(spec.sort).alias("cursor"),
        )
        .withColumn("hasNextPage", F.count("*").over(everything) > spec.first)
        .where(F.col("position") <= spec.first)
    )


def fetch_page(current: DataFrame, spec: QuerySpec) -> Page:
    """One page as rows on the driver, at most `spec.first` + 1 (201) of them.

    The plan ends in the top-k itself, which is the quickest form for a user
    who waits for the page.
    """
    columns = [*[public_column(f) for f in fields.EXPLORE], cursor_token(spec.sort).alias("cursor")]
    found = page_rows(current, spec).select(*columns).collect()
    rows = found[: spec.first]
    return Page(rows, rows[-1].cursor if rows else None, len(found) > spec.first)


def total_count(current: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows in scope; the cursor does not change it."""
    return current.where(page_scope(spec)).agg(F.count("*").alias("total"))


def collect_bounded(df: DataFrame, max_rows: int) -> list[Row]:
    """Fetch a result that must not exceed its bound; fails instead of cutting."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ResultTooLarge(f"more than {max_rows} rows")
    return rows
