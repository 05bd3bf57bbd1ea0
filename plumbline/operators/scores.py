"""Intervals on the mean of one system's scores, or of each of many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import wilson, wilson_columns
from ..functions.special import t_quantile, z_of
from ..plans.checks import is_binary, need_choice, need_confidence, need_finite, need_resamples
from ..plans.draws import percentile_interval, resampled_means
from ..results import ScoreCI

METHODS = ("auto", "wilson", "bootstrap", "t")


def score_stats(scores: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """By group: n, total, mean, sd, low, high and whether all are 0 or 1."""
    x = F.col(score).cast("double")
    return scores.groupBy(*by).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"), is_binary(x).alias("binary"))


def wilson_intervals(scores: DataFrame, by: Sequence[str] = (), score: str = "score", confidence: float = 0.95) -> DataFrame:
    """By group of 0/1 scores: n, estimate, ci_low, ci_high; one pass, all in expressions."""
    stats = score_stats(scores, by, score)
    low, high = wilson_columns(F.col("total"), F.col("n"), z_of(confidence))
    return stats.select(*by, "n", F.col("mean").alias("estimate"), low.alias("ci_low"), high.alias("ci_high"))


def t_intervals(scores: DataFrame, by: Sequence[str] = (), score: str = "score", quantile: float = 1.959963984540054) -> DataFrame:
    """By group: n, mean, sd, standard error, and the mean's interval at a given t or z quantile."""
    stats = score_stats(scores, by, score)
    error = F.col("sd") / F.sqrt("n")
    return stats.select(*by, "n", "mean", "sd", error.alias("se"), (F.col("mean") - quantile * error).alias("ci_low"), (F.col("mean") + quantile * error).alias("ci_high"))


def score_ci(scores: DataFrame, method: str = "auto", confidence: float = 0.95, n_boot: int = 10_000, seed: int | None = None, score: str = "score", order: Sequence[str] = (), key: str = "item_id") -> ScoreCI:
    """The mean's interval: Wilson for 0/1 scores, else a percentile bootstrap, unless a method is named.

    key: the column that tells items apart for the bootstrap's draws; without it equal scores are drawn together.
    order: columns that number the items, for draws from numpy's stream.
    """
    need_choice("method", method, METHODS)
    need_confidence(confidence)
    need_resamples(n_boot)
    n = need_finite(scores, [score], "scores")
    s = score_stats(scores, (), score).first()
    method = method if method != "auto" else "wilson" if s.binary else "bootstrap"
    if method == "wilson":
        if not s.binary:
            raise ValueError("the Wilson interval is for 0/1 scores; use method='bootstrap'")
        low, high = wilson(s.total, n, confidence)
    elif method == "t":
        if s.binary:
            raise ValueError("the t interval is not for 0/1 scores; use method='wilson'")
        if n == 1:
            raise ValueError("one score has no spread to build a t interval on")
        if s.low == s.high:
            raise ValueError("all scores are equal, so a t interval would have no width")
        half = t_quantile(1 - (1 - confidence) / 2, n - 1) * s.sd / n**0.5
        low, high = s.mean - half, s.mean + half
    else:
        low, high = percentile_interval(resampled_means(scores, F.col(score), [key] if key in scores.columns else [], order, n_boot, seed), confidence)
    return ScoreCI(float(s.mean), float(low), float(high), int(n), method, bool(s.binary), confidence)
