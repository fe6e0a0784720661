"""Functions of peak lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import either, in_range


def listed(column: str | Column, kind: str = "double") -> Column:
    """The list, empty for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def packed(*columns: str) -> Column:
    """array<struct> of parallel lists, as long as the longest; shorter and absent lists are filled with nulls."""
    return F.arrays_zip(*[listed(F.col(f"`{c}`").cast("array<double>")).alias(c) for c in columns])


def summed(intensity: str = "intensity") -> Column:
    """Sum of a list, nulls left out."""
    return F.aggregate(listed(intensity), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def count(mz: str = "mz") -> Column:
    return F.size(listed(mz))


def holds(mz: str, windows: list[tuple[float, float]]) -> Column:
    """Whether some peak lies in one of the windows."""
    return F.exists(listed(mz), lambda x: F.coalesce(either([in_range(x, lo, hi) for lo, hi in windows]), F.lit(False)))


def gathered(points: DataFrame, key: str, *, value: str = "mz", beside: str = "intensity") -> DataFrame:
    """A row for each key with its points as two lists in order of `value`; equal values by the other."""
    by = F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias(value), F.col(beside).cast("double").alias(beside))))
    rows = points.groupBy(key).agg(by.alias("p"))
    return rows.select(key, F.col(f"p.{value}").alias(value), F.col(f"p.{beside}").alias(beside))
