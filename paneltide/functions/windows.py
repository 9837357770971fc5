"""Window building blocks. A trailing statistic is null until its window is full; nulls, never NaN, mark missing values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    """Rows of one symbol in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def by_date() -> WindowSpec:
    """All symbols of one date."""
    return Window.partitionBy("ts")


def trailing(n: int, spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_symbol()).rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, spec: WindowSpec | None = None) -> Column:
    """agg over the last n rows, null unless all n values are there."""
    w = trailing(n, spec)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def running(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_symbol()).rowsBetween(Window.unboundedPreceding, 0)


def lag(x: Column, n: int = 1, spec: WindowSpec | None = None) -> Column:
    return F.lag(x, n).over(spec or by_symbol())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def change(x: Column, n: int = 1, spec: WindowSpec | None = None) -> Column:
    """x over its value n rows before, less 1."""
    return ratio(x, lag(x, n, spec)) - 1


def held(enter: Column, leave: Column, spec: WindowSpec | None = None) -> Column:
    """A position that is 1 from a bar on which `enter` holds until one on which `leave` holds. The two must exclude each other."""
    last = F.last(F.when(enter, F.lit(1)).when(leave, F.lit(0)), ignorenulls=True).over(running(spec))
    return F.coalesce(last, F.lit(0))
