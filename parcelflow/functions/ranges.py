"""Ordered values in a bounded number of intervals of about equal counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts(df: DataFrame, values: dict[str, Column], intervals: int) -> dict[str, list]:
    """At most ``intervals - 1`` ascending points for each named column of numbers: one bounded aggregate, whatever the
    input."""
    shares = F.array(*[F.lit(i / intervals) for i in range(1, intervals)])
    row = df.agg(*[F.percentile_approx(value, shares, F.lit(10_000)).alias(name) for name, value in values.items()]).first() if intervals > 1 else {}
    return {name: sorted(set((row and row[name]) or [])) for name in values}


def interval(value: Column, points: list) -> Column:
    """The ordinal of the interval that holds a value: the number of points at or below it, by halving; null for null."""

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < points[middle], halve(low, middle)).otherwise(halve(middle + 1, high))

    return F.when(value.isNotNull(), halve(0, len(points)))
