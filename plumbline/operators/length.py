"""Does length decide who wins? Two logistic fits, each step one aggregate over the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_two_sided, z_of
from ..plans.checks import finite, need_columns, tidy
from ..results import NAN, LengthBias

ONE_OUTCOME = "the outcome never varied, so there is nothing to model"
NO_LENGTH = "every pair had the same length difference, so the predictor is constant"
SEPARATED = "length difference splits the outcome perfectly, so the coefficient is unbounded"
NO_CONVERGENCE = "the fit did not converge"
STEPS, TOLERANCE, LEAST_WEIGHT, CONFIDENCE = 100, 1e-10, 1e-12, 0.95


def choice(c: Column) -> Column:
    """1 for the first option (1 or A), 0 for the second (0 or B), else null."""
    text = F.upper(tidy(c))
    number = text.try_cast("double")
    return F.when(text == "A", 1).when(text == "B", 0).when(number.isin(0.0, 1.0), number.cast("int"))


def predictors(rows: DataFrame) -> DataFrame:
    """y1 picked the first; x1 its length less the other's; y2 departs from the human; x2 what the human passed over less what they picked."""
    a = choice(F.col("preference"))
    gap = (F.col("len_a") - F.col("len_b")).cast("double")
    longer = F.when(a == 1, gap > 0).otherwise(gap < 0).cast("double")
    out = rows.select(a.alias("y1"), gap.alias("x1"), longer.alias("longer"), *([choice(F.col("human_preference")).alias("h")] if "human_preference" in rows.columns else []))
    if "h" in out.columns:
        out = out.withColumns({"y2": (F.col("y1") != F.col("h")).cast("int"), "x2": F.when(F.col("h") == 1, -F.col("x1")).otherwise(F.col("x1"))})
    return out


def outcome_stats(rows: DataFrame, x: str = "x1", y: str = "y1") -> DataFrame:
    """n, n_ones, sd and the predictor's range by outcome: what decides whether there is a fit."""
    one, zero = F.when(F.col(y) == 1, F.col(x)), F.when(F.col(y) == 0, F.col(x))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("n_ones"), F.stddev_samp(x).alias("sd"), F.min(zero).alias("low0"), F.max(zero).alias("high0"), F.min(one).alias("low1"), F.max(one).alias("high1"))


def _sums(rows: DataFrame, b: tuple[float, float]) -> tuple[float, ...]:
    z = F.lit(b[0]) + b[1] * F.col("x")
    p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    w, r, n, x = F.greatest(p * (1 - p), F.lit(LEAST_WEIGHT)), F.col("ones") - F.col("n") * p, F.col("n"), F.col("x")
    return tuple(rows.agg(F.sum(n * w), F.sum(n * w * x), F.sum(n * w * x * x), F.sum(r), F.sum(r * x)).first())


def _step(rows: DataFrame, b: tuple[float, float]) -> tuple[tuple[float, float], float]:
    """The next coefficients and the larger of their moves."""
    w, wx, wxx, r, rx = _sums(rows, b)
    det = w * wxx - wx * wx
    if det <= 0:
        return b, math.nan
    move = ((wxx * r - wx * rx) / det, (w * rx - wx * r) / det)
    return (b[0] + move[0], b[1] + move[1]), max(map(abs, move))


def fit(rows: DataFrame, x: str, y: str) -> tuple[float, float, float, float, str]:
    """Slope, interval, p-value, and why there are none."""
    s = outcome_stats(rows, x, y).first()
    if s.n_ones in (0, s.n):
        return NAN, NAN, NAN, NAN, ONE_OUTCOME
    if min(s.low0, s.low1) == max(s.high0, s.high1):
        return NAN, NAN, NAN, NAN, NO_LENGTH
    if s.high0 < s.low1 or s.high1 < s.low0:
        return NAN, NAN, NAN, NAN, SEPARATED
    # one row a distinct predictor, so that a step costs no more than there are lengths
    cells = rows.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("n"), F.sum(y).alias("ones")).cache()
    b = (0.0, 0.0)
    for _ in range(STEPS):
        b, moved = _step(cells, b)
        if not moved >= TOLERANCE:
            break
    w, wx, wxx, *_ = _sums(cells, b)
    cells.unpersist()
    if math.isnan(moved) or moved >= TOLERANCE or w * wxx <= wx * wx:
        return NAN, NAN, NAN, NAN, NO_CONVERGENCE
    se = math.sqrt(w / (w * wxx - wx * wx))
    half = z_of(CONFIDENCE) * se
    return b[1], b[1] - half, b[1] + half, normal_two_sided(b[1] / se), ""


def length_bias(comparisons: DataFrame) -> LengthBias:
    """From rows (preference, len_a, len_b, and human_preference if there is one); 1 or A is the first option."""
    need_columns(comparisons, ["preference", "len_a", "len_b"], "comparisons")
    has_human = "human_preference" in comparisons.columns
    rows = predictors(comparisons).cache()
    bad = rows.agg(F.count("*"), F.count_if(F.col("y1").isNull()), F.count_if(~finite(F.col("x1"))), F.count_if(F.col("h").isNull()) if has_human else F.lit(0), F.avg("longer"), F.stddev_samp("x1")).first()
    n, no_choice, no_length, no_human, longer, sd = bad
    if not n:
        raise ValueError("comparisons must not be empty")
    if no_choice or no_human:
        raise ValueError(f"preferences must be 0 and 1 or 'A' and 'B'; {no_choice + no_human} are neither")
    if no_length:
        raise ValueError(f"{no_length} comparison(s) lack a finite length")
    first = fit(rows, "x1", "y1")
    second, n_apart, sd2 = (NAN, NAN, NAN, NAN, ""), 0, NAN
    if has_human:
        second = fit(rows, "x2", "y2")
        n_apart, sd2 = rows.agg(F.sum("y2"), F.stddev_samp("x2")).first()
    number = lambda v: NAN if v is None else v
    return LengthBias(*first[:4], number(sd), first[4], *second[:4], number(sd2), second[4], n, n_apart, longer, has_human, CONFIDENCE)
