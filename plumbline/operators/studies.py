"""How often intervals cover the truth: a table is the truth, and disjoint batches of its items are evaluations of it.

Each batch gives an interval; what is reported is the share of batches whose interval has the whole table's value. Batches
are told by a column, so they are groups of one aggregation and none is worked out on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import paired_difference
from ..plans.draws import resampled, unit_number
from .compare import discordance
from .pairwise import ratings_of
from .relational import plain_paired_intervals
from .scores import wilson_intervals


def covers(low: str, high: str, truth: str = "truth") -> Column:
    return F.avg(((F.col(low) <= F.col(truth)) & (F.col(truth) <= F.col(high))).cast("double"))


def score_coverage(scores: DataFrame, by: Sequence[str] = (), batch: str = "batch", score: str = "score", confidence: float = 0.95) -> DataFrame:
    """by, n_batches, covered, missed_below and above, of Wilson's interval of 0/1 scores."""
    found = wilson_intervals(scores, [*by, batch], score, confidence)
    truth = scores.groupBy(*by).agg(F.avg(F.col(score).cast("double")).alias("truth"))
    rows = found.join(truth, list(by)) if by else found.crossJoin(F.broadcast(truth))  # a row
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n_batches"), covers("ci_low", "ci_high").alias("covered"), share(F.col("ci_low") > F.col("truth")).alias("missed_below"), share(F.col("ci_high") < F.col("truth")).alias("missed_above"))


def paired_coverage(pairs: DataFrame, batch: str = "batch", confidence: float = 0.95) -> DataFrame:
    """n_batches and how often Tango's, Wald's and Newcombe's two intervals of a 0/1 difference cover."""

    @F.pandas_udf("low double, high double")
    def score(b: pd.Series, c: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([paired_difference(*map(int, x), confidence) for x in zip(b, c, n, strict=True)], columns=["low", "high"])

    both = F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both")
    stats = discordance(pairs, [batch]).join(pairs.groupBy(batch).agg(both), batch)
    truth = discordance(pairs).select(F.col("difference").alias("truth"))
    rows = plain_paired_intervals(stats, confidence).withColumn("score", score("n_a_only", "n_b_only", "n")).crossJoin(F.broadcast(truth))  # a row
    rows = rows.withColumns({"score_low": F.col("score.low"), "score_high": F.col("score.high")})
    return rows.agg(F.count("*").alias("n_batches"), *(covers(f"{k}_low", f"{k}_high").alias(k) for k in ("wald", "newcombe", "newcombe_corrected", "score")))


def two_sample_coverage(scores: DataFrame, groups: tuple[str, str], n_boot: int = 200, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """n_batches and how often a bootstrap of the items covers the difference of the two groups' means.

    scores: grp, item_id, batch (a long), score. All batches are resampled in one pass.
    """
    two = scores.where(F.col("grp").isin(*groups))
    side = F.when(F.col("grp") == groups[0], 0).otherwise(2)
    sums = F.array(*(F.struct((side + k).cast("long").alias("j"), x.cast("double").alias("x")) for k, x in enumerate((F.lit(1.0), F.col("score")))))
    cells = two.select(unit_number(F.col("item_id")).alias("unit"), F.col("batch").cast("long").alias("i"), F.inline(sums))
    means = {r.grp: r.m for r in two.groupBy("grp").agg(F.avg(F.col("score").cast("double")).alias("m")).collect()}
    draws: list[pd.DataFrame] = []
    for labels, x in resampled(cells, n_boot, seed):
        table = pd.DataFrame(x.T, index=pd.MultiIndex.from_arrays(labels.T)).unstack(level=1)  # a row a batch
        parts = [table.xs(k, axis=1, level=1) for k in range(4)]
        with np.errstate(invalid="ignore", divide="ignore"):
            draws.append(parts[1] / parts[0] - parts[3] / parts[2])
    every = pd.concat(draws, axis=1)
    tail = (1 - confidence) / 2
    ends = every[every.notna().sum(axis=1) >= 0.9 * n_boot].quantile([tail, 1 - tail], axis=1).T
    rows = two.sparkSession.createDataFrame(pd.DataFrame({"low": ends[tail], "high": ends[1 - tail]})).withColumn("truth", F.lit(means[groups[0]] - means[groups[1]]))
    return rows.agg(F.count("*").alias("n_batches"), covers("low", "high").alias("covered"))


def board_coverage(comparisons: DataFrame, batch: str = "batch", n_boot: int = 200, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """n_batches and, of the gaps of batches' ratings: how often items' and comparisons' bootstraps cover those of the whole board,
    and how many gaps they tell from zero.

    comparisons: item_id, model_a, model_b, winner (null or another name: tie), batch; each batch is one task's, with a bounded number of items.
    """
    models = sorted(r[0] for r in comparisons.select("model_a").union(comparisons.select("model_b")).distinct().collect())
    place = {m: k for k, m in enumerate(models)}
    size, tail = len(models), 50 * (1 - confidence)
    first, second = np.triu_indices(size, 1)

    def cells(part: pd.DataFrame) -> np.ndarray:
        a, b = part["model_a"].map(place).to_numpy(), part["model_b"].map(place).to_numpy()
        won = np.where(part["winner"] == part["model_a"], 1.0, np.where(part["winner"] == part["model_b"], 0.0, 0.5))
        out = np.zeros((len(part), size * size))
        out[np.arange(len(part)), a * size + b], out[np.arange(len(part)), b * size + a] = won, 1 - won
        return out

    won = F.when(F.col("winner") == F.col("model_a"), 1.0).when(F.col("winner") == F.col("model_b"), 0.0).otherwise(0.5)
    sums = comparisons.groupBy("model_a", "model_b").agg(F.sum(won).alias("won"), F.count("*").alias("n")).collect()
    credit = np.zeros((size, size))
    for r in sums:
        credit[place[r.model_a], place[r.model_b]] += r.won
        credit[place[r.model_b], place[r.model_a]] += r.n - r.won
    rated = ratings_of(credit)
    truth = rated[first] - rated[second]

    def batch_rows(part: pd.DataFrame) -> pd.DataFrame:
        rows, rng, out = cells(part), np.random.default_rng((seed, int(part[batch].iloc[0]))), {}
        units = {"items": np.unique(part["item_id"], return_inverse=True)[1], "comparisons": np.arange(len(part))}
        for name, unit in units.items():
            by_unit = np.zeros((unit.max() + 1, size * size))
            np.add.at(by_unit, unit, rows)
            times = rng.multinomial(len(by_unit), np.full(len(by_unit), 1 / len(by_unit)), n_boot)
            drawn = (times @ by_unit).reshape(n_boot, size, size)
            drawn = drawn[(drawn + np.eye(size) > 0).all(axis=(1, 2))]
            if len(drawn) < 0.9 * n_boot:
                return pd.DataFrame(columns=columns)
            r = ratings_of(drawn)
            low, high = np.percentile(r[:, first] - r[:, second], [tail, 100 - tail], axis=0)
            out |= {f"covered_{name}": float(((low <= truth) & (truth <= high)).mean()), f"separable_{name}": float(((low > 0) | (high < 0)).sum())}
        return pd.DataFrame([out])[columns]

    columns = [f"{c}_{name}" for name in ("items", "comparisons") for c in ("covered", "separable")]
    found = comparisons.groupBy(batch).applyInPandas(batch_rows, ", ".join(f"{c} double" for c in columns))
    return found.agg(F.count("*").alias("n_batches"), *(F.avg(c).alias(c) for c in columns))
