"""Predicates over variables, built as columns that the Parquet reader can use.

At the top level a null comparison drops the row, so plain comparisons push down; under a negation, and for membership
that must be true or false, nulls count as no match.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scan bounds of a converted unit are widened by this part, so that rounding loses no row; the exact test follows.
SLACK = 1e-12


def in_range(column: Column, low: float, high: float) -> Column:
    """low <= column <= high; an infinite bound is none. Null and NaN never match. No bound: true."""
    tests = []
    if not math.isinf(low):
        tests.append(column >= F.lit(float(low)))
    if not math.isinf(high):
        tests.append(column <= F.lit(float(high)))
    if not tests:
        return F.lit(True)
    if math.isinf(high):
        tests.append(~F.isnan(column))
    return both(tests)


def widened(column: Column, low: float, high: float, factor: float) -> Column:
    """A test on the raw column that holds wherever factor * column lies in the range; for pruning alone."""
    tests = []
    if not math.isinf(low):
        tests.append(column >= F.lit(low / factor - abs(low / factor) * SLACK))
    if not math.isinf(high):
        tests.append(column <= F.lit(high / factor + abs(high / factor) * SLACK))
    return both(tests)


def member(column: Column, values: Sequence) -> Column:
    """Whether the value is one of `values`; null is not. No values: false."""
    return column.isin(list(values)) if values else F.lit(False)


def surely(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def both(tests: Iterable[Column]) -> Column:
    tests = list(tests)
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def either(tests: Iterable[Column]) -> Column:
    tests = list(tests)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def windows(values: Sequence[float], ppm: float | Sequence[float] = 20.0, tolerance: float | Sequence[float] = 0.0) -> list[tuple[float, float]]:
    """value -+ (value * ppm / 10^6 + tolerance); lists of another length than the values give their first to all."""
    n = len(values)

    def each(x) -> list[float]:
        x = [float(v) for v in x] if isinstance(x, (list, tuple)) else [float(x)]
        return x if len(x) == n else [x[0]] * n

    return [(v - (v * p / 1e6 + t), v + (v * p / 1e6 + t)) for v, p, t in zip(map(float, values), each(ppm), each(tolerance), strict=True)]


def span(values: Sequence[float]) -> tuple[float, float]:
    return min(values), max(values)


def exact(x: float | None) -> str:
    """A number as SQL text that reads back as the same double."""
    if x is None:
        return "NULL"
    if math.isinf(x):
        return "1.7976931348623157E308D" if x > 0 else "-1.7976931348623157E308D"
    return f"{float(x)!r}D"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
