"""Robust statistics of short arrays, such as a KPI's values by period, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The factor that makes a median absolute deviation estimate a normal standard deviation.
MAD_SCALE = 1.4826
TINY = 1e-9


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there or in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def median(values: Column) -> Column:
    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        at = lambda k: F.get(ordered, k.cast("int"))
        return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)

    return let(F.sort_array(values), middle)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def deviation(values: Column) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    squares = let(mean(values), lambda centre: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - centre) * (x - centre)))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1)))


def mad(values: Column) -> Column:
    return let(median(values), lambda centre: median(F.transform(values, lambda x: F.abs(x - centre))))


def sigma(values: Column) -> Column:
    """Scaled median absolute deviation, or the standard deviation where that is nil."""
    return let(mad(values) * MAD_SCALE, lambda scaled: F.when(scaled <= TINY, F.coalesce(deviation(values), F.lit(0.0))).otherwise(scaled))


def pct(value: Column, base: Column) -> Column:
    """Change in per cent of the base's size; null at a base of 0."""
    return F.try_divide(value - base, F.abs(base)) * 100


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate over pairs without nulls; null if either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b, n = F.when(both, x), F.when(both, y), F.count(F.when(both, 1))
    cover = F.covar_pop(a, b)
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when((n > 1) & (spread > 1e-12), F.try_divide(cover, spread))
