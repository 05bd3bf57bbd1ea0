"""The margin between two systems, on the same items or on different ones."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import independent_difference, paired_difference
from ..functions.special import binomial_half_two_sided, chi2_one_sf, normal_two_sided, t_quantile, t_two_sided, z_of
from ..plans.checks import finite_counts, is_binary, need_choice, need_confidence, need_finite, need_resamples, need_scores
from ..plans.draws import bootstrap_p, percentile_interval, resampled_means, running, some_seed
from ..plans.walsh import averages_at
from ..results import ComparisonResult

#: Fixed values of the method: discordant items below which McNemar's test is exact; items up to which, and distinct
#: differences from which, the signed-rank test is.
MCNEMAR_EXACT, SIGNED_EXACT, SIGNED_DISTINCT = 25, 50, 3


def paired(left: DataFrame, right: DataFrame, key: str = "item_id", score: str = "score") -> DataFrame:
    """(key, a, b) of items that both sides scored; refuses items that only one did."""
    joined = left.select(key, F.col(score).alias("a"), F.lit(True).alias("in_a")).join(right.select(key, F.col(score).alias("b"), F.lit(True).alias("in_b")), key, "full")
    lone = joined.where("in_a IS NULL OR in_b IS NULL").count()
    if lone:
        raise ValueError(f"{lone} item(s) have a score on one side only; a paired comparison needs both")
    return joined.select(key, "a", "b")


def discordance(pairs: DataFrame, by: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """n, n_a_only, n_b_only, n_discordant and the margin of 0/1 scores."""
    first, second = (F.col(x).cast("double") for x in (a, b))
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((first == 1) & (second == 0)).alias("n_a_only"), F.count_if((first == 0) & (second == 1)).alias("n_b_only"))
    return out.withColumns({"n_discordant": F.col("n_a_only") + F.col("n_b_only"), "difference": (F.col("n_a_only") - F.col("n_b_only")) / F.col("n")})


def mcnemar_p(b: int, c: int) -> float:
    if b + c == 0:
        return 1.0
    if b + c < MCNEMAR_EXACT:
        return binomial_half_two_sided(b, b + c)
    return chi2_one_sf((abs(b - c) - 1) ** 2 / (b + c))


def mcnemar_tests(stats: DataFrame) -> DataFrame:
    """stats of many groups with each one's p-value and whether it is exact."""

    @F.pandas_udf("double")
    def p_value(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype=float)

    return stats.withColumn("p_value", p_value("n_a_only", "n_b_only")).withColumn("exact", F.col("n_discordant") < MCNEMAR_EXACT)


def signed_ranks(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A row a distinct size of difference: ties, mid-rank, and how many are positive. Zero differences are left out.

    Ranks come from a running count over the distinct sizes, not from a sort of all rows.
    """
    d = F.col(a).cast("double") - F.col(b).cast("double")
    return ranks_of(pairs.select(d.alias("d")).where("d <> 0").groupBy("d").agg(F.count("*").alias("n")))


def ranks_of(values: DataFrame) -> DataFrame:
    """signed_ranks of distinct differences with their counts (d, n), none of them zero."""
    sizes = values.groupBy(F.abs("d").alias("size")).agg(F.sum("n").alias("ties"), F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("n_positive"))
    return running(sizes, "size", "ties", "before").withColumn("mid_rank", F.col("before") + (F.col("ties") + 1) / 2).drop("before")


def rank_sums(ranks: DataFrame) -> DataFrame:
    """n, w_positive, w_negative, and the sum of t**3 - t over ties."""
    t = F.col("ties").cast("double")
    return ranks.agg(F.sum("ties").alias("n"), F.sum(F.col("mid_rank") * F.col("n_positive")).alias("w_positive"), F.sum(F.col("mid_rank") * (F.col("ties") - F.col("n_positive"))).alias("w_negative"), F.sum(t * t * t - t).alias("tie_correction"))


def walsh(differences: DataFrame, d: str = "d") -> DataFrame:
    """(w): averages of all pairs i <= j of the differences, from their distinct values with counts."""
    values = differences.groupBy(F.col(d).alias("x")).agg(F.count("*").alias("n"))
    left, right = values.alias("l"), values.alias("r")
    n = F.when(F.col("l.x") == F.col("r.x"), F.col("l.n") * (F.col("l.n") + 1) / 2).otherwise(F.col("l.n") * F.col("r.n"))
    return left.join(right, F.col("l.x") <= F.col("r.x")).select(((F.col("l.x") + F.col("r.x")) / 2).alias("w"), n.cast("long").alias("n")).groupBy("w").agg(F.sum("n").alias("n"))


def null_ranks(n: int) -> list[int]:
    """Sign patterns of n ranks by their positive sum."""
    counts = [1]
    for rank in range(1, n + 1):
        wider = counts + [0] * rank
        for s, c in enumerate(counts):
            wider[s + rank] += c
        counts = wider
    return counts


def signed_trim(n: int, confidence: float, exact: bool, tie_correction: float = 0.0) -> int:
    """Walsh averages to leave out at either end."""
    tail = (1 - confidence) / 2
    if not exact:
        sd = math.sqrt(max(n * (n + 1) * (2 * n + 1) - tie_correction / 2, 0.0) / 24)
        return math.floor(n * (n + 1) / 4 - z_of(confidence) * sd)
    total, below, trim = 2**n, 0, 0
    for s, c in enumerate(null_ranks(n)):
        below += c
        if below / total > tail:
            break
        trim = s
    return trim


def signed_p(n: int, w_positive: float, w_negative: float, exact: bool, tie_correction: float) -> float:
    w = min(w_positive, w_negative)
    if exact:
        return min(1.0, 2 * sum(null_ranks(n)[: int(w) + 1]) / 2**n)
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_correction / 2) / 24)
    return normal_two_sided((w - n * (n + 1) / 4) / sd)


def wilcoxon(pairs: DataFrame, binary: bool, confidence: float) -> ComparisonResult:
    """The signed-rank test with the Hodges-Lehmann shift and its interval, all from distinct differences and counts."""
    d = pairs.select((F.col("a").cast("double") - F.col("b").cast("double")).alias("d")).where("d <> 0")
    values = d.groupBy("d").agg(F.count("*").alias("n")).persist()
    try:
        distinct = values.count()
        if not distinct:
            return ComparisonResult(0.0, 0.0, 0.0, 1.0, 0, "wilcoxon", binary, True, confidence)
        if distinct < SIGNED_DISTINCT:
            raise ValueError(f"the differences take {distinct} value(s) other than zero, too few for an interval by ranks; use method='mcnemar' or 'bootstrap'")
        sums = rank_sums(ranks_of(values)).first()
        n, ties = int(sums.n), float(sums.tie_correction)
        exact = n <= SIGNED_EXACT and ties == 0
        total = n * (n + 1) // 2
        k = min(max(signed_trim(n, confidence, exact, 0.0 if exact else ties), 0), (total - 1) // 2)
        below, above, low, high = averages_at(values, distinct, [(total - 1) // 2, total // 2, k, total - 1 - k])
    finally:
        values.unpersist()
    return ComparisonResult((below + above) / 2, low, high, signed_p(n, sums.w_positive, sums.w_negative, exact, ties), n, "wilcoxon", binary, True, confidence)


def compare_paired(pairs: DataFrame, method: str = "auto", confidence: float = 0.95, n_boot: int = 10_000, seed: int | None = None, order: Sequence[str] = (), key: str = "item_id") -> ComparisonResult:
    """The margin a - b over rows (a, b), one an item: McNemar's test with Tango's interval for 0/1, else a bootstrap of items.

    key: the column that tells items apart for the bootstrap's draws; without it equal differences are drawn together.
    order: columns that number the items, for draws from numpy's stream.
    """
    need_choice("method", method, ("auto", "mcnemar", "bootstrap", "wilcoxon"))
    need_confidence(confidence)
    need_resamples(n_boot)
    a, b = (F.col(c).cast("double") for c in ("a", "b"))
    counts = [F.count_if((a == 1) & (b == 0)).alias("n_a_only"), F.count_if((a == 0) & (b == 1)).alias("n_b_only")]
    s = pairs.agg(*finite_counts(pairs, ["a", "b"]), (is_binary(a) & is_binary(b)).alias("binary"), F.avg(a - b).alias("mean"), *counts).first()
    n = need_scores(*s[:3], "scores")
    method = method if method != "auto" else "mcnemar" if s.binary else "bootstrap"
    if method == "mcnemar":
        if not s.binary:
            raise ValueError("McNemar's test is for 0/1 scores; use method='bootstrap' or 'wilcoxon'")
        low, high = paired_difference(s.n_a_only, s.n_b_only, n, confidence)
        return ComparisonResult((s.n_a_only - s.n_b_only) / n, low, high, mcnemar_p(s.n_a_only, s.n_b_only), n, method, True, True, confidence, s.n_a_only + s.n_b_only)
    if method == "wilcoxon":
        return wilcoxon(pairs, s.binary, confidence)
    means = resampled_means(pairs, F.col("a").cast("double") - F.col("b").cast("double"), [key] if key in pairs.columns else [], order, n_boot, seed, n)
    return ComparisonResult(s["mean"], *percentile_interval(means, confidence), bootstrap_p(means), n, method, s.binary, True, confidence)


def group_stats(scores: DataFrame, by: str = "grp", score: str = "score") -> DataFrame:
    x = F.col(score).cast("double")
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), is_binary(x).alias("binary"))


def pooled_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """The two-proportion statistic; null where the pooled rate leaves no variance."""
    p = (k1 + k2) / (n1 + n2)
    return (k1 / n1 - k2 / n2) / F.nullif(F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), F.lit(0.0))


def welch(m1: float, v1: float, n1: int, m2: float, v2: float, n2: int, confidence: float) -> tuple[float, float, float]:
    """Interval and p-value of a difference of means."""
    e1, e2 = v1 / n1, v2 / n2
    se = math.sqrt(e1 + e2)
    if se == 0:
        raise ValueError("neither side varies, so a t interval would have no width")
    df = (e1 + e2) ** 2 / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))
    half = t_quantile(1 - (1 - confidence) / 2, df) * se
    return m1 - m2 - half, m1 - m2 + half, t_two_sided((m1 - m2) / se, df)


def compare_independent(left: DataFrame, right: DataFrame, method: str = "auto", confidence: float = 0.95, n_boot: int = 10_000, seed: int | None = None, score: str = "score", order: Sequence[str] = (), key: str = "item_id") -> ComparisonResult:
    """The margin of two systems on different items: a score interval with a pooled z test for 0/1, else a bootstrap.

    key and order as compare_paired has them; the second side's keyed draws have the seed after the first side's, and
    numpy's stream gives the first side's draws before the second's.
    """
    need_choice("method", method, ("auto", "score", "bootstrap", "t"))
    need_confidence(confidence)
    need_resamples(n_boot)
    n1, n2 = need_finite(left, [score], "the first scores"), need_finite(right, [score], "the second scores")
    a, b = (group_stats(x.withColumn("grp", F.lit(0)), "grp", score).first() for x in (left, right))
    binary, difference = bool(a.binary and b.binary), a["mean"] - b["mean"]
    method = method if method != "auto" else "score" if binary else "bootstrap"
    if method == "score":
        if not binary:
            raise ValueError("the score interval is for 0/1 scores; use method='bootstrap' or 't'")
        low, high = independent_difference(a.total, n1, b.total, n2, confidence)
        p = (a.total + b.total) / (n1 + n2)
        se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
        p_value = normal_two_sided(difference / se) if se else 1.0
    elif method == "t":
        if min(n1, n2) < 2:
            raise ValueError("a t interval needs two scores or more on either side")
        low, high, p_value = welch(a["mean"], a.variance, n1, b["mean"], b.variance, n2, confidence)
    else:
        seed = some_seed(seed)
        seeds = (np.random.default_rng(seed),) * 2 if order else (seed, seed + 1)
        one, two = (resampled_means(x, F.col(score), [key] if key in x.columns else [], order, n_boot, own, n) for x, own, n in zip((left, right), seeds, (n1, n2), strict=True))
        means = one - two
        low, high = percentile_interval(means, confidence)
        p_value = bootstrap_p(means)
    return ComparisonResult(float(difference), float(low), float(high), float(p_value), n1 + n2, method, binary, False, confidence)
