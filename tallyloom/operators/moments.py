"""Samples that are never gathered: co-moments in one aggregate, left-out correlations and resampling by weights from sums."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.order import counted, quantiles, totals
from tallyloom.sources.scratch import kept

_NORMAL = NormalDist()
#: Cumulative probabilities of 0, 1, 2, ... events where one is expected.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(18))


@dataclass(frozen=True)
class Moments:
    """Of the rows in which all of some columns are known: how many, covariances, and each column's extremes."""

    n: int
    cov: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def constant(self, k: int, relative: bool = True) -> bool:
        size = max(1.0, abs(self.low[k]), abs(self.high[k])) if relative else 1.0
        return bool(self.high[k] - self.low[k] <= 1e-12 * size)

    def r(self, a: int = 0, b: int = 1) -> float | None:
        """Pearson's r of two of the columns; None of fewer than two rows or if either hardly varies."""
        if self.n < 2:
            return None
        spread = self.n * math.sqrt(max(0.0, self.cov[a, a] * self.cov[b, b]))
        scale = math.prod(max(1.0, abs(self.low[k]), abs(self.high[k])) for k in (a, b))
        return None if spread <= 1e-12 * scale else float(np.clip(self.n * self.cov[a, b] / spread, -1, 1))

    def partial(self) -> float | None:
        """Correlation of the first two columns given all others; None if these are collinear."""
        scale = np.sqrt(np.diag(self.cov))
        if not scale.all():
            return None
        matrix = self.cov / np.outer(scale, scale)
        if not np.isfinite(matrix).all() or np.linalg.cond(matrix) > 1e8:
            return None
        inverse = np.linalg.inv(matrix)
        return float(np.clip(-inverse[0, 1] / math.sqrt(inverse[0, 0] * inverse[1, 1]), -1, 1))


def moments(sample: DataFrame, sets: list[tuple[str, ...]]) -> list[Moments]:
    """For each set of columns the moments of the rows in which it is known, all from one aggregate.

    What comes to the driver is one row of sums, however many members or periods the sample has.
    """
    aggs: list[Column] = []
    for s, columns in enumerate(sets):
        known = F.lit(True)
        for c in columns:
            known = known & F.col(c).isNotNull()
        own = [F.when(known, F.col(c).cast("double")) for c in columns]
        aggs.append(F.count(F.when(known, 1)).alias(f"n{s}"))
        aggs += [f(v).alias(f"{name}{s}_{i}") for i, v in enumerate(own) for name, f in (("low", F.min), ("high", F.max))]
        aggs += [F.covar_pop(own[i], own[j]).alias(f"c{s}_{i}_{j}") for i in range(len(own)) for j in range(i, len(own))]
    row = sample.agg(*aggs).first().asDict()
    number = lambda v: float("nan") if v is None else float(v)
    out = []
    for s, columns in enumerate(sets):
        k = range(len(columns))
        cov = np.array([[number(row[f"c{s}_{min(i, j)}_{max(i, j)}"]) for j in k] for i in k])
        out.append(Moments(row[f"n{s}"], cov, *[np.array([number(row[f"{name}{s}_{i}"]) for i in k]) for name in ("low", "high")]))
    return out


def _centred(sample: DataFrame, x: str, y: str) -> DataFrame:
    """(entity, x, y) of the rows in which both are known, less their means: sums of products then lose nothing."""
    rows = sample.select("entity", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    return totals(rows, [], mx=F.avg("x"), my=F.avg("y")).select("entity", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))


def _terms() -> dict[str, Column]:
    x, y = F.col("x"), F.col("y")
    return {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}


def _r(prefix: str) -> Column:
    """r from sums; null where a side hardly varies."""
    s = {k: F.col(f"{prefix}{k}") for k in ("n", "x", "y", "xx", "yy", "xy")}
    top, vx, vy = s["n"] * s["xy"] - s["x"] * s["y"], s["n"] * s["xx"] - s["x"] * s["x"], s["n"] * s["yy"] - s["y"] * s["y"]
    flat = (vx <= 1e-12 * s["n"] * s["xx"]) | (vy <= 1e-12 * s["n"] * s["yy"])
    return F.when((s["n"] > 1) & ~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), top / F.sqrt(vx * vy))))


def left_out(sample: DataFrame, x: str, y: str) -> DataFrame:
    """(entity, r_without): the correlation over all rows of ``sample(entity, x, y)`` but one, from the sums less its own terms."""
    rows = _centred(sample, x, y)
    rows = totals(rows, [], **{f"s_{k}": F.sum(v) for k, v in _terms().items()})
    return rows.select("entity", *[(F.col(f"s_{k}") - v).alias(f"w_{k}") for k, v in _terms().items()]).select("entity", _r("w_").alias("r_without"))


def replicates(sample: DataFrame, x: str, y: str, draws: int = 4000, seed: int = 0) -> DataFrame:
    """(draw, r): the correlation in each of ``draws`` resamples of ``sample(entity, x, y)``.

    How often a row is in a resample is a Poisson number from a digest of its entity and the draw, so that resamples are
    sums by draw: rows are weighed where they lie, tasks send a row for each draw, and reruns agree.
    """
    rows = _centred(sample, x, y).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("entity").cast("string"), "draw"), F.lit(1 << 52)) / float(1 << 52)
    rows = rows.withColumn("share", share).withColumn("times", sum(((F.col("share") >= p).cast("int") for p in POISSON), F.lit(0)))
    sums = rows.where("times > 0").groupBy("draw").agg(*[F.sum(F.col("times") * v).alias(f"s_{k}") for k, v in _terms().items()])
    return sums.select("draw", _r("s_").alias("r"))


def bca_interval(sample: DataFrame, x: str, y: str, alpha: float = 0.05, draws: int = 4000, seed: int = 0) -> tuple[float, float] | None:
    """A bias-corrected and accelerated bootstrap interval of r over any number of rows; None if resamples have no r."""
    rows = kept(sample.select("entity", x, y))
    r = moments(rows, [(x, y)])[0].r()
    if r is None:
        return None
    found = kept(replicates(rows, x, y, draws, seed).where("r is not null"))
    of = found.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("r") < r).cast("double")).alias("below")).first()
    left = left_out(rows, x, y)
    away = totals(left, [], mean=F.avg("r_without")).withColumn("away", F.col("mean") - F.col("r_without"))
    own = away.agg(F.count(F.when(F.col("r_without").isNull(), 1)).alias("none"), F.sum(F.pow("away", F.lit(2.0))).alias("two"), F.sum(F.pow("away", F.lit(3.0))).alias("three")).first()
    if of["n"] < draws // 2 or own["none"]:
        return None
    bias = _NORMAL.inv_cdf(min(max(of["below"], 1 / draws), 1 - 1 / draws))
    speed = own["three"] / (6 * own["two"] ** 1.5) if own["two"] else 0.0

    def level(of: float) -> float:
        z = bias + _NORMAL.inv_cdf(of)
        return _NORMAL.cdf(bias + z / (1 - speed * z))

    row = quantiles(counted(found, {"r": F.col("r")}), {"low": level(alpha / 2), "high": level(1 - alpha / 2)}).first()
    return row["low"], row["high"]
