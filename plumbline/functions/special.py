"""Tail probabilities, quantiles and roots for finishers on a few numbers; no SciPy."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def z_of(confidence: float) -> float:
    """Half-width, in standard errors, of a central normal interval."""
    return normal_quantile(1 - (1 - confidence) / 2)


def normal_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def normal_two_sided(x: float) -> float:
    return math.erfc(abs(x) / math.sqrt(2))


def chi2_one_sf(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta, by Lentz's continued fraction on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    tiny, c, total = 1e-300, 1.0, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = total = 1 / (d if abs(d) > tiny else tiny)
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) * total / a


def root(f: Callable[[float], float], low: float, high: float, steps: int = 200) -> float:
    """Where f changes sign between low and high: bisection to the last bit, so no derivative can mislead it."""
    at_low = f(low)
    for _ in range(steps):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        value = f(mid)
        if (value > 0) == (at_low > 0):
            low = mid
        else:
            high = mid
    return (low + high) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return root(lambda x: beta_cdf(x, a, b) - p, 0.0, 1.0)


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """Upper quantiles by inverting the two-sided tail; lower ones by symmetry."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    if p == 0.5:
        return 0.0
    x = beta_quantile(2 * (1 - p), df / 2, 0.5)
    return math.sqrt(df * (1 - x) / x) if x > 0 else math.inf


def binomial_half_cdf(k: int, n: int) -> float:
    """P(at most k of n fair coins)."""
    if k >= n:
        return 1.0
    if n <= 1000:
        return float(sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if k >= 0 else 0.0
    return 1 - beta_cdf(0.5, k + 1, n - k)


def binomial_half_two_sided(k: int, n: int) -> float:
    return min(1.0, 2 * binomial_half_cdf(min(k, n - k), n)) if n else math.nan


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
