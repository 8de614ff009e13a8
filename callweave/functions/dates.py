"""Publication-date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(column: Column, strict: bool = True) -> Column:
    """Timestamp of a text; ``strict=False`` gives null where the text is no timestamp."""
    return F.to_timestamp(column) if strict else F.try_to_timestamp(column)


def publish_year(ts: Column) -> Column:
    return F.year(ts)


def publish_month(ts: Column) -> Column:
    return F.month(ts)


def year_quarter(ts: Column) -> Column:
    """Label such as ``2020Q3``."""
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
