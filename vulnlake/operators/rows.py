"""Public projections of finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.functions.values import iso_ms


def public_column(field: str) -> Column:
    column = F.col(fields.column_of(field))
    if field in fields.DATES:
        column = iso_ms(column)
    return column.alias(field)


def project_explore(findings: DataFrame) -> DataFrame:
    return findings.select(*[public_column(f) for f in fields.EXPLORE])


def project_detail(findings: DataFrame) -> DataFrame:
    return findings.select(*[public_column(f) for f in fields.DETAIL])
