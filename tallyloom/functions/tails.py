"""Tail probabilities of correlations, their intervals, and false discovery rates, as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.robust import let

#: Lanczos' coefficients of the logarithm of the gamma function (g = 7, nine terms).
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """For arguments of 0.5 and more."""
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (z + F.lit(float(k)))
    t = z + F.lit(LANCZOS_G - 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z - 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method, in as many steps as its arguments need."""
    guard = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    steps = F.sequence(F.lit(2), (F.lit(200) + 8 * F.sqrt(a + b)).cast("int"))
    first = 1 / guard(1 - (a + b) * x / (a + 1))
    state = lambda c, d, out: F.struct(c.alias("c"), d.alias("d"), out.alias("out"))

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        by = F.when(k % 2 == 0, even).otherwise(odd)
        c, d = guard(1 + by / s["c"]), 1 / guard(1 + by * s["d"])
        return state(c, d, s["out"] * c * d)

    return F.aggregate(steps, state(F.lit(1.0), first, first), step, lambda s: s["out"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    near = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)


def correlation_p(r: Column, n: Column, controls: int = 0) -> Column:
    """Two-sided p of a (partial) correlation over n pairs by Student's t; null without a degree of freedom."""
    df = (n - 2 - controls).cast("double")
    tail = let(F.struct(df.alias("df"), (1 - r * r).alias("x")), lambda s: incomplete_beta(s["df"] / 2, F.lit(0.5), s["x"]))
    return F.when(r.isNull() | (df < 1), None).when(F.abs(r) >= 1, 0.0).otherwise(tail)


def fisher_interval(r: Column, n: Column, alpha: float = 0.05, controls: int = 0) -> tuple[Column, Column]:
    """Ends of Fisher's interval; null where n is too small or r is 1 in size."""
    free = n - 3 - controls
    half = NormalDist().inv_cdf(1 - alpha / 2) / F.sqrt(free.cast("double"))
    known = (free >= 1) & (F.abs(r) < 1)
    return F.when(known, F.tanh(F.atanh(r) - half)), F.when(known, F.tanh(F.atanh(r) + half))


def least_detectable(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """The least r that n pairs would show with the given power."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when(n > 3, F.tanh(z / F.sqrt((n - 3).cast("double"))))


def with_q(df: DataFrame, p: str = "p_value", name: str = "q_value", within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with Benjamini and Hochberg's q of each p in its family (all rows, or those that share ``within``).

    From the largest p down, the least of p times the family's size over its rank so far; null ones stay null and don't
    count. A family is one of hypotheses that a caller names, so it fits one window.
    """
    family = Window.partitionBy(*within)
    up, down = Window.partitionBy(*within, F.col(p).isNull()).orderBy(F.col(p)), Window.partitionBy(*within).orderBy(F.col(p).desc_nulls_last(), F.desc("_rank"))
    ranked = df.withColumns({"_rank": F.row_number().over(up), "_of": F.count(p).over(family)})
    least = F.min(F.col(p) * F.col("_of") / F.col("_rank")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_rank", "_of")
