"""Intervals on proportions and their differences: the closed ones as Columns, the others as finishers on counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import beta_quantile, root, z_of

#: Stands for a statistic whose variance vanished away from the hypothesis.
EDGE = 1e6


def wilson_columns(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Bounds on k of n, as expressions; null where n is 0."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p = k / n
    centre, width, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.greatest((centre - width) / scale, F.lit(0.0)), F.least((centre + width) / scale, F.lit(1.0))


def wilson(k: float, n: int, confidence: float) -> tuple[float, float]:
    z, p = z_of(confidence), k / n
    centre, width, scale = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return max((centre - width) / scale, 0.0), min((centre + width) / scale, 1.0)


def clopper_pearson(k: int, n: int, confidence: float) -> tuple[float, float]:
    tail = (1 - confidence) / 2
    return (beta_quantile(tail, k, n - k + 1) if k else 0.0), (beta_quantile(1 - tail, k + 1, n - k) if k < n else 1.0)


def _ratio(gap: float, variance: float) -> float:
    if variance > 0:
        return gap / math.sqrt(variance)
    return math.copysign(EDGE, gap) if gap else 0.0


def paired_score(b: int, c: int, n: int, delta: float) -> float:
    """Tango's statistic for a difference of delta, given b and c items that only one side passed."""
    linear = (2 * n - b + c) * delta - b - c
    rate = (math.sqrt(max(linear * linear + 8 * n * c * delta * (1 - delta), 0.0)) - linear) / (4 * n)
    return _ratio(b - c - n * delta, n * (2 * rate + delta * (1 - delta)))


def independent_score(k1: float, n1: int, k2: float, n2: int, delta: float) -> float:
    """Mee's statistic: rates are those most likely under the difference, the root of a cubic in the first rate."""
    p1, p2 = k1 / n1, k2 / n2
    gap = p1 - p2 - delta
    if gap == 0:
        return 0.0
    ratio = n2 / n1
    lead = 1 + ratio
    square = -(lead + p1 + ratio * p2 + delta * (ratio + 2)) / lead
    linear = (delta * delta + delta * (2 * p1 + lead) + p1 + ratio * p2) / lead
    constant = -p1 * delta * (1 + delta) / lead
    shift = square / 3
    spread = math.sqrt(max(shift * shift - linear / 3, 0.0))
    skew = shift**3 - square * linear / 6 + constant / 2
    if spread == 0:
        rate = -shift
    else:
        spread = math.copysign(spread, skew) if skew else -spread
        angle = (math.pi + math.acos(min(max(skew / spread**3, -1.0), 1.0))) / 3
        rate = 2 * spread * math.cos(angle) - shift
    other = rate - delta
    return _ratio(gap, rate * (1 - rate) / n1 + other * (1 - other) / n2)


def _inverted(statistic, estimate: float, confidence: float, edge: float = 1 - 1e-9) -> tuple[float, float]:  # noqa: ANN001
    """The differences that a falling statistic doesn't reject."""
    z = z_of(confidence)
    low = high = None
    if estimate <= -edge or statistic(-edge) <= z:
        low = -1.0
    if estimate >= edge or statistic(edge) >= -z:
        high = 1.0
    if low is None:
        low = root(lambda d: statistic(d) - z, -edge, estimate)
    if high is None:
        high = root(lambda d: statistic(d) + z, estimate, edge)
    return low, high


def paired_difference(b: int, c: int, n: int, confidence: float) -> tuple[float, float]:
    return _inverted(lambda d: paired_score(b, c, n, d), (b - c) / n, confidence)


def independent_difference(k1: float, n1: int, k2: float, n2: int, confidence: float) -> tuple[float, float]:
    return _inverted(lambda d: independent_score(k1, n1, k2, n2, d), k1 / n1 - k2 / n2, confidence)
