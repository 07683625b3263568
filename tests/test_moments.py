"""Co-moments, tails, false discovery rates and resampling against samples that are held whole."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.errors import InvalidArgument
from tallyloom.functions import stats, tails
from tallyloom.operators import contest, moments
from tallyloom.plans.kpi import kpi
from tallyloom.sources.facts import from_frame

NORMAL = NormalDist()


def pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    if len(x) < 2:
        return None
    a, b = x - x.mean(), y - y.mean()
    spread = math.sqrt(float(a @ a) * float(b @ b))
    scale = max(float(np.abs(x).max()), 1.0) * max(float(np.abs(y).max()), 1.0)
    return None if spread <= 1e-12 * scale else float(np.clip(a @ b / spread, -1, 1))


def partial(columns: list[np.ndarray]) -> float | None:
    """Correlation of the first two columns given all others, from the inverse of their correlation matrix; null if that is singular."""
    matrix = np.corrcoef(np.array(columns))
    if not np.isfinite(matrix).all() or np.linalg.cond(matrix) > 1e8:
        return None
    inverse = np.linalg.inv(matrix)
    return float(np.clip(-inverse[0, 1] / math.sqrt(inverse[0, 0] * inverse[1, 1]), -1, 1))


def bca_interval(x: np.ndarray, y: np.ndarray, alpha: float = 0.05, draws: int = 4000, seed: int = 0) -> tuple[float, float] | None:
    """A bias-corrected and accelerated bootstrap interval of r; null if resamples have no r."""
    n, random = len(x), np.random.default_rng(seed)
    picks = random.integers(0, n, (draws, n))
    a, b = x[picks], y[picks]
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    spread = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    found = (a * b).sum(axis=1)[spread > 0] / spread[spread > 0]
    r = pearson(x, y)
    if r is None or len(found) < draws // 2:
        return None
    share = float(np.clip((found < r).mean(), 1 / draws, 1 - 1 / draws))
    bias = NORMAL.inv_cdf(share)
    left = [pearson(np.delete(x, k), np.delete(y, k)) for k in range(n)]
    if any(v is None for v in left):
        return None
    away = np.mean(left) - np.array(left)
    scale = float((away**2).sum()) ** 1.5
    speed = float((away**3).sum()) / (6 * scale) if scale > 0 else 0.0

    def cut(level: float) -> float:
        z = bias + NORMAL.inv_cdf(level)
        return float(np.quantile(found, NORMAL.cdf(bias + z / (1 - speed * z))))

    return cut(alpha / 2), cut(1 - alpha / 2)


# -- tails -------------------------------------------------------------------------------------------------------------


def test_tails_as_columns(spark):
    cases = [(r, n, k) for r in (-0.999, -0.5, -0.1, 0.0, 0.003, 0.25, 0.7, 0.97, 1.0, None) for n in (2, 3, 4, 6, 9, 30, 31, 400, 100_000) for k in (0, 2)]
    frame = spark.createDataFrame(cases, "r double, n long, k int")
    got = {}
    for k in (0, 2):
        low, high = tails.fisher_interval(F.col("r"), F.col("n"), 0.05, k)
        rows = frame.where(F.col("k") == k).select("r", "n", tails.correlation_p(F.col("r"), F.col("n"), k).alias("p"), low.alias("low"), high.alias("high"), tails.least_detectable(F.col("n")).alias("least")).collect()
        got |= {(r["r"], r["n"], k): (r["p"], r["low"], r["high"], r["least"]) for r in rows}
    for r, n, k in cases:
        p, low, high, least = got[r, n, k]
        want = None if r is None else stats.correlation_p(r, n, k)
        assert p == pytest.approx(want, rel=1e-9, abs=1e-300) if want is not None else p is None
        ends = None if r is None else stats.fisher_interval(r, n, 0.05, k)
        assert (low, high) == pytest.approx(ends) if ends else (low, high) == (None, None)
        assert least == (pytest.approx(stats.least_detectable(n)) if n > 3 else None)


def test_tails_of_a_table(spark):
    """Critical values of r at 5 % and 1 % from printed tables."""
    for r, df, p in ((0.632, 8, 0.05), (0.765, 8, 0.01), (0.423, 20, 0.05), (0.537, 20, 0.01), (0.195, 100, 0.05)):
        assert spark.range(1).select(tails.correlation_p(F.lit(r), F.lit(df + 2))).first()[0] == pytest.approx(p, rel=0.02)


def test_false_discovery_rates(spark):
    own = random.Random(3)
    families = {f: [own.choice([None, 0.04, round(own.random() ** 3, 4)]) for _ in range(n)] for f, n in (("a", 1), ("b", 12), ("c", 40))}
    frame = spark.createDataFrame([(f, k, p) for f, ps in families.items() for k, p in enumerate(ps)], "f string, k int, p_value double")
    got = {(r["f"], r["k"]): r["q_value"] for r in tails.with_q(frame, within=("f",)).collect()}
    for f, ps in families.items():
        assert [got[f, k] for k in range(len(ps))] == [q if q is None else pytest.approx(q) for q in stats.q_values(ps)]


# -- moments -----------------------------------------------------------------------------------------------------------


def holes(n, seed=5):
    own = np.random.default_rng(seed)
    c = own.normal(size=n)
    columns = {"y": 3 * c + own.normal(size=n), "a": 2 * c + own.normal(size=n) + 1e6, "b": own.normal(size=n), "c": c, "same": np.full(n, 7.0)}
    return {k: [None if own.random() < 0.15 else float(x) for x in v] for k, v in columns.items()}


def sample(spark, columns, parts=5):
    rows = list(zip([f"e{k}" for k in range(len(next(iter(columns.values()))))], *columns.values(), strict=True))
    return spark.createDataFrame(rows, "entity string, " + ", ".join(f"{c} double" for c in columns)).repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_moments(spark, n):
    columns = holes(n)
    sets = [("y", "a"), ("y", "b"), ("y", "a", "c"), ("y", "a", "b", "c"), ("y", "same")]
    for names, got in zip(sets, moments.moments(sample(spark, columns), sets), strict=True):
        rows = [r for r in zip(*[columns[c] for c in names], strict=True) if None not in r]
        held = [np.array(c) for c in zip(*rows, strict=True)] if rows else [np.array([])] * len(names)
        assert got.n == len(rows)
        want = pearson(*held[:2])
        assert got.r() == (None if want is None else pytest.approx(want, abs=1e-9))
        if len(rows) > len(names) and "same" not in names:
            assert got.partial() == pytest.approx(partial(held), abs=1e-6) and not any(map(got.constant, range(len(names))))
    if n == 300:
        taken = moments.moments(sample(spark, columns), [("y", "a"), ("y", "a", "c"), ("y", "a", "a")])
        assert taken[0].r() > 0.8 and abs(taken[1].partial()) < 0.2 and taken[2].partial() is None


@pytest.mark.parametrize("n", [2, 3, 40])
def test_left_out(spark, n):
    columns = holes(n, 9)
    held = {f"e{k}": (x, y) for k, (x, y) in enumerate(zip(columns["a"], columns["y"], strict=True)) if None not in (x, y)}
    got = {r["entity"]: r["r_without"] for r in moments.left_out(sample(spark, columns), "a", "y").collect()}
    assert got.keys() == held.keys()
    for e, r in got.items():
        rest = [v for k, v in held.items() if k != e]
        want = pearson(np.array([x for x, _ in rest]), np.array([y for _, y in rest])) if len(rest) > 1 else None
        assert r == (None if want is None else pytest.approx(want, abs=1e-6))


def test_resampled_intervals(spark):
    """Within 0.02 of resampling whole samples, on average over 10 samples of 30; far less for large ones."""
    apart = []
    for seed in range(10):
        own = np.random.default_rng(seed)
        x = own.normal(size=30)
        y = own.choice([0.3, 1.0, 3.0]) * x + own.normal(size=30)
        frame = sample(spark, {"x": x.tolist(), "y": y.tolist()}, 2)
        got = moments.bca_interval(frame, "x", "y")
        apart += [abs(a - b) for a, b in zip(got, bca_interval(x, y), strict=True)]
        if seed == 0:
            assert moments.bca_interval(frame, "x", "y") == got and got[0] < pearson(x, y) < got[1]
    assert np.mean(apart) < 0.02 and max(apart) < 0.06
    own = np.random.default_rng(1)
    x = own.normal(size=2000)
    y = x + own.normal(size=2000)
    low, high = moments.bca_interval(sample(spark, {"x": x.tolist(), "y": y.tolist()}), "x", "y", draws=800)
    assert (low, high) == (pytest.approx(stats.fisher_interval(pearson(x, y), 2000)[0], abs=0.01), pytest.approx(stats.fisher_interval(pearson(x, y), 2000)[1], abs=0.01))
    assert moments.bca_interval(sample(spark, {"x": [1.0] * 9, "y": list(map(float, range(9)))}), "x", "y") is None


# -- the tools ---------------------------------------------------------------------------------------------------------


def changes(spark, members=40):
    """Members whose price follows their demand, and a quarter before for each."""
    own, rows = random.Random(6), []
    for k in range(members):
        c = own.gauss(0, 5)
        moves = {"y": 3 * c + own.gauss(0, 2), "a": 2 * c + own.gauss(0, 2), "c": c, "z": own.gauss(0, 5)}
        rows += [("2026-02-02", f"m{k}", *[100.0] * 4), ("2026-05-04", f"m{k}", *[100.0 + v for v in moves.values()])]
    return from_frame(spark.createDataFrame(rows, "date string, m string, y double, a double, c double, z double"), ["m"], ["y", "a", "c", "z"], [kpi(k, "sum", "{" + k + "}") for k in "yacz"])


def test_a_sample_of_any_size_is_tested(spark):
    f, scope = changes(spark), {"dimension": "m", "period_a": "2026-Q2", "period_b": "2026-Q1"}
    found = contest.statistical_significance(f, "y", candidates=["a", "z"], **scope)["tests"]
    assert found[0]["significant"] and not found[1]["significant"] and found[0]["q_value"] == pytest.approx(2 * found[0]["p_value"])
    taken = contest.confounders(f, "y", "a", ["c", "z"], **scope)
    assert [g["effect"] for g in taken["each"]][1] == "unchanged" and abs(taken["joint"]["partial_r"]) < abs(taken["baseline"]["r"]) and taken["joint"]["n"] == 40
    with pytest.raises(InvalidArgument):
        contest.confounders(f, "y", "a", [f"k{i}" for i in range(11)], **scope)
    size = contest.effect_size(f, "y", "a", **scope)
    assert size["bootstrap_status"] == "ok" and size["bootstrap"][0] < size["r"] < size["bootstrap"][1]
    ranked = contest.competing(f, "y", ["z", "c"], include_precedence=False, include_consistency=False, **scope)["causes"]
    assert [c["cause"] for c in ranked] == ["c", "z"] and ranked[0]["q_value"] < 0.05
    kept = contest.outlier_sensitivity(f, "y", "a", "2026-Q2", "2026-Q1", "m")
    assert kept["verdict"] == "robust" and len(kept["without"]) == kept["members"] == 40


def test_spurious_trends(spark):
    own = random.Random(2)
    rows = [(f"{2020 + k // 12}-{k % 12 + 1:02}-05", "m", 10.0 * k + own.gauss(0, 5), 7.0 * k + own.gauss(0, 5), 20.0 * (k % 5) + 3 * k, 60.0 * (k % 5) + own.gauss(0, 1)) for k in range(60)]
    f = from_frame(spark.createDataFrame(rows, "date string, m string, y double, a double, c double, z double"), ["m"], ["y", "a", "c", "z"], [kpi(k, "sum", "{" + k + "}") for k in "yacz"])
    trend = contest.spurious(f, "y", "a", "month")
    assert trend["verdict"] == "trend_driven" and trend["level"]["r"] > 0.99 and trend["slopes"][0] == pytest.approx(10, abs=0.3)
    assert contest.spurious(f, "c", "z", "month")["verdict"] == "survives_detrending"
    assert contest.spurious(f, "y", "a", "month", "2020")["level"]["n"] == 12 and contest.spurious(f, "y", "a", "quarter", "2020")["verdict"] == "insufficient"
