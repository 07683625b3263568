"""Distribution tails and intervals of single values on the driver; ``tails`` has them as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation_p(r: float, n: int, controls: int = 0) -> float | None:
    df = n - 2 - controls
    if df < 1:
        return None
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt(df / (1 - r * r)), df)


def fisher_interval(r: float, n: int, alpha: float = 0.05, controls: int = 0) -> tuple[float, float] | None:
    if n - 3 - controls < 1 or abs(r) >= 1:
        return None
    half = _NORMAL.inv_cdf(1 - alpha / 2) / math.sqrt(n - 3 - controls)
    return math.tanh(math.atanh(r) - half), math.tanh(math.atanh(r) + half)


def least_detectable(n: int, alpha: float = 0.05, power: float = 0.8) -> float | None:
    return math.tanh((_NORMAL.inv_cdf(1 - alpha / 2) + _NORMAL.inv_cdf(power)) / math.sqrt(n - 3)) if n > 3 else None


def q_values(p: list[float | None]) -> list[float | None]:
    """Benjamini and Hochberg's q of each p in its family; missing ones stay missing and don't count."""
    known = sorted((x, k) for k, x in enumerate(p) if x is not None)
    out: list[float | None] = [None] * len(p)
    least = 1.0
    for rank in range(len(known), 0, -1):
        x, k = known[rank - 1]
        least = min(least, x * len(known) / rank)
        out[k] = least
    return out
