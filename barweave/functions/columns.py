"""Expressions that several transforms share. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def clean(x: Column | str) -> Column:
    """As a double, with NaN as null (Spark sorts NaN above every number, so guards need this first)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def is_none(x: Column) -> Column:
    return x.isNull()


def is_inf(x: Column) -> Column:
    return F.coalesce(F.abs(x) == float("inf"), F.lit(False))


def is_valid(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.coalesce(F.isnan(x), F.lit(False)) & ~is_inf(x)


def rolling(aggregate: Callable[[WindowSpec], Column], present: Column, order: WindowSpec, first: int, last: int) -> Column:
    """An aggregate over rows [first, last] around each row, null unless the frame is whole and without nulls.

    present: not null where the frame's row counts as valid. One count covers both warm-up and nulls.
    """
    frame = order.rowsBetween(first, last)
    return F.when(F.count(present).over(frame) == last - first + 1, aggregate(frame))


def lag(x: Column, n: int, order: WindowSpec) -> Column:
    return F.lag(x, n).over(order)


def lead(x: Column, n: int, order: WindowSpec) -> Column:
    return F.lead(x, n).over(order)


def shift(x: Column, n: int, order: WindowSpec) -> Column:
    """The value n rows before (n > 0) or -n rows after; null beyond the series."""
    return F.lag(x, n).over(order) if n >= 0 else F.lead(x, -n).over(order)


def pairwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op of two values, null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), op(a, b))


def difference_quotient(now: Column, before: Column, log: bool) -> Column:
    """The return from `before` to `now`; simple ones need before > 0, logarithmic ones both."""
    if log:
        return F.when((before > 0) & (now > 0), F.ln(now / before))
    return F.when(before > 0, (now - before) / before)


def linear_slope(x: Column, y: Column) -> tuple[Callable[[WindowSpec], Column], Callable[[WindowSpec], Column]]:
    """(slope, R squared) of y on x over a frame; both null if x is constant, R squared also if y is."""

    def slope(frame):
        return F.try_divide(F.regr_sxy(y, x).over(frame), F.regr_sxx(y, x).over(frame))

    def fit(frame):
        xy = F.regr_sxy(y, x).over(frame)
        return F.try_divide(F.try_divide(xy, F.regr_sxx(y, x).over(frame)) * xy, F.regr_syy(y, x).over(frame))

    return slope, fit


def std_dev(x: Column) -> Column:
    """Sample standard deviation of a whole column or group; null if a value is null or under two exist."""
    return F.when((F.count(x) == F.count(F.lit(1))) & (F.count(x) >= 2), F.stddev_samp(x))
