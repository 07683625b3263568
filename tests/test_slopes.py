"""Median slopes by selection against the slopes of all pairs."""

import numpy as np
import pytest

from tallyloom.operators import slopes

SHAPES = {
    "noise": lambda x, rng: rng.normal(size=len(x)) * 1e5 + 3 * x,
    "constant": lambda x, rng: np.full(len(x), 7.0),
    "ties": lambda x, rng: rng.integers(0, 3, len(x)).astype(float),
    "line": lambda x, rng: 0.1 * x + 5,
    "steps": lambda x, rng: np.floor(x / 100),
    "heavy tails": lambda x, rng: rng.standard_cauchy(len(x)) * 1e6,
    "two values": lambda x, rng: np.arange(len(x)) % 2 * 1.0,
    "curve": lambda x, rng: x**2,
    "one huge value": lambda x, rng: np.where(np.arange(len(x)) == 1, 1e18, x + np.sin(x)),
}


def all_pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    return float(np.median((y[j] - y[i]) / (x[j] - x[i])))


def test_inversions_are_counted_and_listed():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ranks = rng.permutation(int(rng.integers(1, 50)))
        want = sorted((a, b) for k, a in enumerate(ranks.tolist()) for b in ranks[k + 1 :].tolist() if a > b)
        larger, smaller = slopes.inverted(ranks)
        assert slopes.inversions(ranks) == len(want) and sorted(zip(larger.tolist(), smaller.tolist(), strict=True)) == want
        if want:
            assert 5 <= len(slopes.inverted(ranks, 5)[0]) or len(want) < 5


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("n", [2, 3, 5, 60, 601, 2000])
def test_selection_equals_all_pairs(shape, n, monkeypatch):
    monkeypatch.setattr(slopes, "SHORT", 1)
    rng = np.random.default_rng(n)
    x = rng.choice(3 * n, n, replace=False).astype(float) + 10_000
    order = np.argsort(x)
    y = np.empty(n)
    y[order] = SHAPES[shape](x[order], rng)
    assert slopes.median_slope(x, y) == pytest.approx(all_pairs(x[order], y[order]), rel=1e-9, abs=1e-11)


def test_long_series_need_no_pairs():
    n = 90_000
    x = np.arange(n, dtype=float)
    y = np.where(np.arange(n) % 3 == 0, 2 * x, 2 * x + 1000 * np.sin(x))
    assert slopes.median_slope(x, y) == pytest.approx(2.0, abs=1e-3)
    assert slopes.median_slope(x[:1], y[:1]) is None


def test_both_ways_agree_in_spark(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(o), float(v)) for k, n in (("a", 1500), ("b", 40), ("c", 1)) for o, v in zip(rng.choice(5000, n, replace=False), rng.normal(size=n), strict=True)]
    points = spark.createDataFrame(rows, "kpi string, ord long, value double")
    got = {g: {r["kpi"]: r["slope"] for r in slopes.slopes(points, g).collect() if r["slope"] is not None} for g in ("day", "month")}
    assert set(got["day"]) == {"a", "b"} and got["day"] == pytest.approx(got["month"], rel=1e-12)
    assert slopes.slopes(points.limit(0), "day").count() == 0
