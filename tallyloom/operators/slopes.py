"""Median slopes of long series without all pairs of their points.

A slope between two points is at most m exactly if the later point lies no higher once m times the time is taken away, so
the slopes up to m are counted as inversions of an order. Halving m leaves few slopes around the middle ones; only these
are listed. Memory is linear in the points, time n log n for each halving.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grains of which even a long history has few periods, so that all pairs of them may be joined.
COARSE = ("year", "quarter", "month")
#: Series of at most this many points list all their slopes at once, half a million.
SHORT = 1000


def _levels(ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit of a permutation's values from the top: the values, grouped by their higher bits in their first order,
    which of them have the bit, how many with it come before each in its group, and where its group's first one stands among those with it."""
    own = np.asarray(ranks, np.int64)
    for bit in reversed(range(max(1, int(len(own) - 1).bit_length()))):
        one = (own >> bit) & 1
        seen = np.concatenate(([0], np.cumsum(one)))
        first = seen[(own >> (bit + 1)) << (bit + 1)]
        yield own, one, seen[:-1] - first, first
        own = own[np.argsort(own >> bit, kind="stable")]


def inversions(ranks: np.ndarray) -> int:
    """Pairs of places whose values, a permutation of 0 to n - 1, fall."""
    return sum(int(before[one == 0].sum()) for _, one, before, _ in _levels(ranks))


def inverted(ranks: np.ndarray, enough: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The values (larger, smaller) of each inversion, the larger one standing first; of ``enough`` at least, if that is given."""
    larger, smaller, found = [], [], 0
    for own, one, before, first in _levels(ranks):
        low = np.flatnonzero((one == 0) & (before > 0))
        if enough is not None:
            low = low[: 1 + np.searchsorted(np.cumsum(before[low]), enough - found)]
        times = before[low]
        start = np.repeat(first[low] - np.concatenate(([0], np.cumsum(times)))[:-1], times)
        larger.append(own[np.flatnonzero(one)[start + np.arange(int(times.sum()))]])
        smaller.append(np.repeat(own[low], times))
        found += int(times.sum())
        if enough is not None and found >= enough:
            break
    return np.concatenate(larger), np.concatenate(smaller)


def median_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """The median of (y_j - y_i) / (x_j - x_i) over all pairs, for distinct finite x; None for fewer than two points.

    Long series are exact but for slopes that rounding cannot tell apart, as where many are equal.
    """
    order = np.argsort(x, kind="stable")
    x, y, n = np.asarray(x, float)[order], np.asarray(y, float)[order], len(x)
    if n < 2:
        return None
    if n <= SHORT:
        i, j = np.triu_indices(n, 1)
        return float(np.median((y[j] - y[i]) / (x[j] - x[i])))
    pairs = n * (n - 1) // 2
    return (_nth(x, y, (pairs - 1) // 2) + (_nth(x, y, pairs // 2) if pairs % 2 == 0 else 0.0)) / (2 - pairs % 2)


def _nth(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """The slope at place k, from 0, of all pairs of points in the order of distinct x."""
    n, u, v = len(x), x - x[0], y - np.median(y)

    def place(m: float) -> np.ndarray:
        """Points in the order of what is left of them above a line of slope m; of equals the later comes first."""
        return np.lexsort((-u, v - m * u))

    steps = np.diff(v) / np.diff(u)  # every slope lies between the least and the greatest step
    most = float(np.abs(steps).max())
    if not most:
        return 0.0
    low, high = float(steps.min()) - 1e-6 * most, float(steps.max()) + 1e-6 * most
    fine = 4 * np.finfo(float).eps
    upto, below = n * (n - 1) // 2, 0
    while upto - below > 4 * n and high - low > max(fine * max(abs(low), abs(high)), fine * fine * most):
        mid = low + (high - low) / 2
        count = inversions(place(mid))
        if count > k:
            high, upto = mid, count
        else:
            low, below = mid, count
    first, last = place(low), place(high)
    ranks = np.empty(n, np.int64)
    ranks[last] = np.arange(n)
    alike = upto - below > 4 * n
    a, b = inverted(ranks[first], n if alike else None)
    i, j = last[a], last[b]
    found = np.sort((y[j] - y[i]) / (x[j] - x[i]))
    if alike:
        return float(found[len(found) // 2])
    below -= int((i > j).sum())  # pairs that rounding has on the wrong side of low
    return float(found[min(max(k - below, 0), len(found) - 1)])


def slopes(points: DataFrame, grain: str) -> DataFrame:
    """(kpi, slope) of ``points(kpi, ord, value)``: Theil and Sen's slope for each KPI that has two points.

    Quarters and months are joined with each other; weeks and days, of which there may be tens of thousands, are selected
    from without their pairs, one KPI's series in a group. Values must not be null, places must differ within a KPI.
    """
    points = points.select("kpi", F.col("ord").cast("double").alias("ord"), F.col("value").cast("double").alias("value"))
    if grain in COARSE:
        p, q = points.alias("p"), points.alias("q")
        each = (F.col("q.value") - F.col("p.value")) / (F.col("q.ord") - F.col("p.ord"))
        return p.join(q, (F.col("p.kpi") == F.col("q.kpi")) & (F.col("p.ord") < F.col("q.ord"))).groupBy(F.col("p.kpi").alias("kpi")).agg(F.median(each).alias("slope"))

    def one(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kpi": own["kpi"].iloc[:1], "slope": [median_slope(own["ord"].to_numpy(), own["value"].to_numpy())]})

    return points.groupBy("kpi").applyInPandas(one, "kpi string, slope double")
