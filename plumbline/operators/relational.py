"""Relational steps around the statistics: joins that check their keys, votes, first rows, agreement of raw pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import z_of
from ..plans.checks import need_unique


def winner_name(side: Column, a: Column, b: Column) -> Column:
    """Which option won, from 'model_a', 'model_b' or anything else for a tie."""
    return F.when(side == "model_a", a).when(side == "model_b", b).otherwise("tie")


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def join_one(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join whose right side has one row a key, which is checked."""
    need_unique(one, keys, "the right side of this join needs one row a key")
    return many.join(one, list(keys), how)


def with_raters(rows: DataFrame, unit: str, rater: str, least: int = 2) -> DataFrame:
    """Rows of units that `least` different raters or more have seen."""
    known = rows.groupBy(unit).agg(F.count_distinct(rater).alias("n_seen")).where(F.col("n_seen") >= least).select(unit)
    return rows.join(known, unit, "left_semi")


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; by aggregation, so a frequent key is cut down before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first_row"))
    return first.select(*keys, *(F.col(f"first_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def plurality(rows: DataFrame, unit: str, label: str) -> DataFrame:
    """unit, n, verdict: the most frequent label, 'tie' if there are several."""
    counts = rows.groupBy(unit, label).agg(F.count("*").alias("c"))
    top = F.max("c").over(Window.partitionBy(unit))
    best = counts.withColumn("top", top).groupBy(unit).agg(F.sum("c").alias("n"), F.count_if(F.col("c") == F.col("top")).alias("n_best"), F.max_by(label, "c").alias("v"))
    return best.select(unit, "n", F.when(F.col("n_best") > 1, "tie").otherwise(F.col("v")).alias("verdict"))


def pair_agreement(rows: DataFrame, unit: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """n_units, n_pairs, n_agreeing, the pooled share, and the mean share a unit, over pairs of labels of one unit."""
    c = rows.groupBy(*by, unit, label).agg(F.count("*").alias("c"))
    units = c.groupBy(*by, unit).agg(F.sum("c").alias("m"), (F.sum(F.col("c") * (F.col("c") - 1)) / 2).alias("same")).where("m >= 2")
    pairs = F.col("m") * (F.col("m") - 1) / 2
    out = units.groupBy(*by).agg(F.count("*").alias("n_units"), F.sum(pairs).cast("long").alias("n_pairs"), F.sum("same").cast("long").alias("n_agreeing"), F.avg(F.col("same") / pairs).alias("mean_share"))
    return out.withColumn("pooled_share", F.col("n_agreeing") / F.nullif(F.col("n_pairs"), F.lit(0)))


def funnel(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """(step, n): rows left after each condition in turn; one pass."""
    so_far, counts = F.lit(True), []
    for name, condition in steps.items():
        so_far = so_far & F.coalesce(condition, F.lit(False))
        counts.append(F.struct(F.lit(len(counts)).alias("at"), F.lit(name).alias("step"), F.count_if(so_far).alias("n")))
    return rows.agg(*(c.alias(f"s{k}") for k, c in enumerate(counts))).select(F.inline(F.array(*(f"s{k}" for k in range(len(counts))))))


def codings(rows: DataFrame, a: str = "model_a", b: str = "model_b", winner: str = "winner") -> DataFrame:
    """rows with the verdict by name, by alphabetical place of the pair, and by place shown."""
    low, _ = unordered(F.col(a), F.col(b))
    tied = F.col(winner).isNull() | (F.col(winner) == "tie")
    return rows.withColumns({
        "by_name": F.when(tied, "tie").otherwise(F.col(winner)),
        "by_alphabet": F.when(tied, "tie").when(F.col(winner) == low, "first").otherwise("second"),
        "by_place": F.when(tied, "tie").when(F.col(winner) == F.col(a), "first").otherwise("second"),
    })


def width_ratios(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """Of two tables of pairs with intervals: n_pairs, the ratio of their mean widths, and its square, the design effect."""
    w = wide.select("model_a", "model_b", (F.col("ci_high") - F.col("ci_low")).alias("w1"))
    n = narrow.select("model_a", "model_b", (F.col("ci_high") - F.col("ci_low")).alias("w2"))
    means = w.join(n, ["model_a", "model_b"]).agg(F.count("*").alias("n_pairs"), (F.avg("w1") / F.nullif(F.avg("w2"), F.lit(0.0))).alias("width_ratio"))
    return means.withColumn("design_effect", F.col("width_ratio") * F.col("width_ratio"))


def apart(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """pairs with `apart`: whether the two ratings' intervals have no number in common.

    A rule that misses gaps which the gap's own interval tells from zero; reports use `separable`.
    """
    for side in ("a", "b"):
        pairs = pairs.join(ratings.select(F.col("model").alias(f"model_{side}"), F.col("ci_low").alias(f"low_{side}"), F.col("ci_high").alias(f"high_{side}")), f"model_{side}", "left")
    return pairs.withColumn("apart", F.greatest("low_a", "low_b") > F.least("high_a", "high_b")).drop("low_a", "low_b", "high_a", "high_b")


def plain_paired_intervals(stats: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Wald's and Newcombe's intervals on a paired difference, from (n, n_a_only, n_b_only, n_both): for comparison only.

    Newcombe's comes plain and with his correction, which takes half an item off a positive correlation. They cover too little near the edges; reports use Tango's.
    """
    z = z_of(confidence)
    n, b, c, both = (F.col(x).cast("double") for x in ("n", "n_a_only", "n_b_only", "n_both"))
    d = (b - c) / n
    wald = z * F.sqrt(b + c - (b - c) * (b - c) / n) / n

    def wilson(k: Column) -> tuple[Column, Column]:
        p = k / n
        centre, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
        return (centre - half) / scale, (centre + half) / scale

    first, second = both + b, both + c
    (l1, u1), (l2, u2) = wilson(first), wilson(second)
    p1, p2, neither = first / n, second / n, n - both - b - c
    spread = F.sqrt(first * second * (n - first) * (n - second))
    cross = both * neither - b * c
    within = lambda x, most: F.least(F.greatest(x, F.lit(-most)), F.lit(most))
    out = {"difference": d, "wald_low": within(d - wald, 1.0), "wald_high": within(d + wald, 1.0)}
    for name, joint in (("newcombe", cross), ("newcombe_corrected", F.when(cross < 0, cross).otherwise(F.greatest(cross - n / 2, F.lit(0.0))))):
        phi = within(F.coalesce(joint / F.nullif(spread, F.lit(0.0)), F.lit(0.0)), 1.0)
        side = lambda x, y: F.sqrt(F.greatest(x * x - 2 * phi * x * y + y * y, F.lit(0.0)))  # noqa: B023, E731
        out |= {f"{name}_low": within(d - side(p1 - l1, u2 - p2), 1.0), f"{name}_high": within(d + side(u1 - p1, p2 - l2), 1.0)}
    return stats.withColumns(out)
