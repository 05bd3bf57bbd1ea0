"""Does the place in which an option is shown decide who wins?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import clopper_pearson, wilson
from ..functions.special import binomial_half_two_sided
from ..plans.checks import need_columns, need_ids
from ..results import NAN, PositionBias

COLUMNS = ["pair_id", "option_a", "option_b", "winner"]
#: Share of pairs judged both ways from which the design is read as such; and the one confidence of this report.
BOTH_ORDERS, CONFIDENCE = 0.5, 0.95


def cleaned(rows: DataFrame) -> DataFrame:
    need_columns(rows, COLUMNS, "comparisons")
    a, b, w = (F.col(c) for c in COLUMNS[1:])
    n, same, strange = rows.agg(F.count("*"), F.count_if(F.coalesce(a == b, F.lit(False))), F.count_if(w.isNotNull() & ~F.coalesce((w == a) | (w == b), F.lit(False)))).first()
    if not n:
        raise ValueError("comparisons must not be empty")
    need_ids(rows, COLUMNS[:3], "comparisons")
    if same:
        raise ValueError(f"{same} comparison(s) show one option against itself")
    if strange:
        raise ValueError(f"{strange} comparison(s) have a winner that was not on offer; leave it empty for a tie")
    return rows


def design(rows: DataFrame) -> DataFrame:
    """n_pairs, n_both_orders, design."""
    shown = rows.select("pair_id", "option_a", "option_b").distinct()
    turned = shown.select("pair_id", F.col("option_a").alias("option_b"), F.col("option_b").alias("option_a"))
    both = shown.join(turned, ["pair_id", "option_a", "option_b"], "left_semi").select("pair_id").distinct().withColumn("both", F.lit(1))
    counts = shown.select("pair_id").distinct().join(both, "pair_id", "left").agg(F.count("*").alias("n_pairs"), F.count("both").alias("n_both_orders"))
    is_both = (F.col("n_both_orders") > 0) & (F.col("n_both_orders") >= BOTH_ORDERS * F.col("n_pairs"))
    return counts.withColumn("design", F.when(is_both, "both_orders").otherwise("randomised"))


def shown_first(rows: DataFrame) -> DataFrame:
    """n_judgements, n_decisive, n_ties, n_a_wins."""
    return rows.agg(F.count("*").alias("n_judgements"), F.count("winner").alias("n_decisive"), (F.count("*") - F.count("winner")).alias("n_ties"), F.count_if(F.col("winner") == F.col("option_a")).alias("n_a_wins"))


def couples(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The reversed couple of each pair that closes first: pair_id, whether its winner held, and whether the flip went to the first shown.

    An order of options enters a couple with its earliest decisive row, so one row per pair and order is enough.
    """
    decisive = rows.where(F.col("winner").isNotNull())
    first = decisive.groupBy("pair_id", "option_a", "option_b").agg(F.min(F.struct(order, "winner")).alias("f"))
    one, two = first.alias("x"), first.alias("y")
    met = one.join(two, (F.col("x.pair_id") == F.col("y.pair_id")) & (F.col("x.option_a") == F.col("y.option_b")) & (F.col("x.option_b") == F.col("y.option_a")) & (F.col(f"x.f.{order}") < F.col(f"y.f.{order}")))
    couple = met.select(F.col("x.pair_id").alias("pair_id"), F.col(f"y.f.{order}").alias("closed"), (F.col("x.f.winner") == F.col("y.f.winner")).alias("consistent"), ((F.col("x.f.winner") == F.col("x.option_a")) & (F.col("y.f.winner") == F.col("y.option_a"))).alias("to_first"))
    best = couple.groupBy("pair_id").agg(F.min(F.struct("closed", "consistent", "to_first")).alias("c"))
    return best.select("pair_id", F.col("c.consistent").alias("consistent"), F.col("c.to_first").alias("to_first"))


def couple_counts(rows: DataFrame, order: str = "seq") -> DataFrame:
    return couples(rows, order).agg(F.count("*").alias("n_scored"), F.count_if("consistent").alias("n_consistent"), F.count_if(~F.col("consistent")).alias("n_flipped"), F.count_if(~F.col("consistent") & F.col("to_first")).alias("n_first"))


def _rate(k: int, n: int) -> tuple[float, float, float, float]:
    return (k / n, *clopper_pearson(k, n, CONFIDENCE), binomial_half_two_sided(k, n)) if n else (NAN,) * 4


def position_bias(comparisons: DataFrame, seed: int | None = None, order: str | None = None) -> PositionBias:
    """From rows (pair_id, option_a shown first, option_b, winner or null). order: the column that says what came first.

    seed is taken for symmetry with the other reports and not used.
    """
    rows = cleaned(comparisons)
    if order is None:  # the rows themselves, which puts them in some fixed order
        rows, order = rows.withColumn("shown_seq", F.struct(*COLUMNS)), "shown_seq"
    d, s = design(rows).first(), shown_first(rows).first()
    if d.design == "randomised":
        rate, low, high, p = _rate(s.n_a_wins, s.n_decisive)
        return PositionBias(d.design, rate, low, high, p, rate, s.n_a_wins, s.n_decisive, NAN, d.n_pairs, s.n_decisive, s.n_judgements, d.n_both_orders, s.n_ties, CONFIDENCE, low, high)
    c = couple_counts(rows, order).first()
    rate, low, high, p = _rate(c.n_first, c.n_flipped)
    held, held_low, held_high = (c.n_consistent / c.n_scored, *wilson(c.n_consistent, c.n_scored, CONFIDENCE)) if c.n_scored else (NAN,) * 3
    return PositionBias(d.design, held, held_low, held_high, p, rate, c.n_first, c.n_flipped, held, d.n_pairs, c.n_scored, s.n_judgements, d.n_both_orders, s.n_ties, CONFIDENCE, low, high)


