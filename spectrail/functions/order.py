"""Dense positions of rows in an order, without one task seeing all of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StructType

#: Rows a part that are looked at to place cuts.
LOOK = 50


def cuts_of(df: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 ascending values that deal a column of any ordered type, structs included, about evenly.

    Some rows are looked at to place the cuts, as Spark does for its own ranges; results never depend on where they are.
    """
    if parts < 2 or not (n := df.count()):
        return []
    seen = df.select(column) if n <= parts * LOOK else df.select(column).sample(parts * LOOK / n, 7)

    def order(x) -> tuple:
        return (x is not None, tuple(order(v) for v in x) if isinstance(x, tuple) else x if x is not None else 0)

    found = sorted((r[0] for r in seen.collect()), key=order)
    cuts = [found[i * len(found) // parts] for i in range(1, parts)] if found else []
    return [c for i, c in enumerate(cuts) if c is not None and (not i or c != cuts[i - 1])]


def _constant(value, kind: DataType) -> Column:
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[_constant(v, f.dataType).alias(f.name) for v, f in zip(value, kind, strict=True)])
    return F.lit(value).cast(kind)


def place_among(value: Column, cuts: list, kind: DataType) -> Column:
    """How many of the cuts are not above the value (nulls are least): a search in two steps, about 2 sqrt(cuts) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.array(*[_constant(b[-1], kind) for b in blocks])
    fine = F.array(*[F.array(*[_constant(c, kind) for c in b]) for b in blocks])
    block = F.size(F.filter(coarse, lambda c: c <= value))
    inner = F.coalesce(F.size(F.filter(F.get(fine, block), lambda c: c <= value)), F.lit(0))
    return F.when(value.isNull(), 0).otherwise(F.least(block * step, F.lit(len(cuts))) + F.when(block < len(blocks), inner).otherwise(0)).cast("int")


def with_position(df: DataFrame, by: str, name: str = "position", parts: int | None = None) -> DataFrame:
    """`df` with each row's place, from 0, in the order of the column `by` (null first; equal values in any order).

    Quantiles of a numeric column, or cuts of any other, deal the rows to ranges; a range's rows are numbered by themselves, from
    the sum of the counts of the ranges before it. The driver sees a number for each range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[by].dataType
    if isinstance(kind, NumericType):
        shares = [i / parts for i in range(1, parts)]
        cuts = sorted(set((df.select(F.percentile_approx(by, shares, 10_000)).first()[0] if shares else []) or []))
    else:
        cuts = cuts_of(df, by, parts)
    df = df.withColumn("_range", F.when(F.col(by).isNull(), -1).otherwise(place_among(F.col(by), cuts, kind)))
    counts = {r["_range"]: r["count"] for r in df.groupBy("_range").count().collect()}
    base, bases = 0, []
    for k in sorted(counts):
        bases += [F.lit(k), F.lit(base).cast("long")]
        base += counts[k]
    if not bases:
        return df.withColumn(name, F.lit(0).cast("long")).drop("_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(by).asc_nulls_first())) - 1
    return df.withColumn(name, F.element_at(F.create_map(*bases), F.col("_range")) + inside).drop("_range")
