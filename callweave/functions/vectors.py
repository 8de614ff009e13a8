"""Vector expressions on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scrub(vector: Column) -> Column:
    """NaN and both infinities become zero."""
    inf = float("inf")
    return F.transform(
        vector.cast("array<double>"),
        lambda x: F.when(F.isnan(x) | (F.abs(x) == inf) | x.isNull(), 0.0).otherwise(x),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded value without a negative zero, for results that are compared or printed."""
    rounded = F.round(value, digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
