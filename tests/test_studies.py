import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.intervals import wilson
from plumbline.operators.relational import apart, plain_paired_intervals, width_ratios
from plumbline.operators.studies import board_coverage, paired_coverage, score_coverage, two_sample_coverage


def uniform(*key):
    """A number from 0 to 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / 2**53


def test_wilson_covers_as_it_should(spark):
    """Of 4,000 batches of 30 items: the same as counting the batches by hand, and close to what is known of the method."""
    scores = spark.range(120_000).select(F.col("id").alias("item_id"), F.floor(F.col("id") / 30).alias("batch"), (uniform("id") < 0.9).cast("int").alias("score"))
    got = score_coverage(scores).first()
    table = scores.toPandas()
    truth, by = table["score"].mean(), table.groupby("batch")["score"].sum()
    ends = np.array([wilson(int(k), 30, 0.95) for k in by])
    inside = (ends[:, 0] <= truth) & (truth <= ends[:, 1])
    assert tuple(got) == pytest.approx((4000, inside.mean(), (ends[:, 0] > truth).mean(), (ends[:, 1] < truth).mean()))
    assert got.covered == pytest.approx(0.97, abs=0.015)


def test_paired_intervals_cover_as_is_known(spark):
    """Correlated passes of 0.75 and 0.60 in batches of 100; known of 4,000 such: 0.9475, 0.9477, 0.9523, 0.9520."""
    z = lambda *key: F.sqrt(-2 * F.log(uniform(*key))) * F.cos(2 * np.pi * uniform(*key, F.lit("angle")))
    shared = 0.5**0.5
    side = lambda k, cut: (shared * z("id", F.lit("both")) + shared * z("id", F.lit(k)) < cut).cast("int")
    rows = spark.range(200_000).select(F.floor(F.col("id") / 100).alias("batch"), side(1, 0.6744897501960817).alias("a"), side(2, 0.2533471031357997).alias("b"))
    got = paired_coverage(rows).first()
    assert got[0] == 2000 and got[1:] == pytest.approx((0.9475, 0.9477, 0.9523, 0.9520), abs=0.02)


def test_two_sample_bootstrap_covers_as_is_known(spark):
    """Exponential means of 1.5 and 1.0 in batches of 40 and 120; known of 5,000 such: 0.9302."""
    rows = spark.range(64_000).select(F.col("id").alias("item_id"), F.floor(F.col("id") / 160).alias("batch"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("grp"))
    rows = rows.withColumn("score", -F.log(uniform("item_id")) * F.when(F.col("grp") == "a", 1.5).otherwise(1.0))
    got = two_sample_coverage(rows, ("a", "b"), n_boot=300)
    assert got.first()[0] == 400 and got.first().covered == pytest.approx(0.9302, abs=0.04)


def test_boards_cover_less_where_items_move_them_and_single_comparisons_are_drawn(spark):
    """Each item shifts its models; comparisons drawn singly are then told apart too easily."""
    strength = {"a": 1.0, "b": 0.4, "c": -0.2, "d": -1.2}
    pairs = [(x, y) for x in strength for y in strength if x < y]
    rng = np.random.default_rng(7)
    rows = []
    for item in range(2000):
        own = {m: s + rng.normal(0, 1) for m, s in strength.items()}
        for k in range(12):
            x, y = pairs[(item + k) % 6]
            rows.append((item, item // 40, x, y, x if rng.random() < 1 / (1 + np.exp(own[y] - own[x])) else y))
    got = board_coverage(spark.createDataFrame(rows, "item_id long, batch long, model_a string, model_b string, winner string")).first()
    assert got.n_batches == 50
    assert got.covered_items > 0.9 > got.covered_comparisons > 0.6
    assert got.separable_items < got.separable_comparisons


def test_design_effect_is_of_mean_widths(spark):
    wide = spark.createDataFrame([("x", "y", 0.0, 3.0), ("x", "z", 0.0, 1.0)], "model_a string, model_b string, ci_low double, ci_high double")
    narrow = spark.createDataFrame([("x", "y", 0.0, 1.0), ("x", "z", 0.0, 1.0)], wide.schema)
    assert width_ratios(wide, narrow).first()[:] == (2, 2.0, 4.0)


def test_apart(spark):
    ratings = spark.createDataFrame([("x", 1.0, 2.0), ("y", 2.0, 3.0), ("z", 2.5, 4.0)], "model string, ci_low double, ci_high double")
    found = apart(spark.createDataFrame([("x", "y"), ("z", "x"), ("z", "y")], "model_a string, model_b string"), ratings)
    assert sorted((r.model_a, r.model_b, r.apart) for r in found.collect()) == [("x", "y", False), ("z", "x", True), ("z", "y", False)]


def test_plain_intervals_stay_differences(spark):
    r = plain_paired_intervals(spark.createDataFrame([(4, 4, 0, 0), (3, 0, 3, 0)], "n long, n_a_only long, n_b_only long, n_both long")).collect()
    for row in r:
        for name in ("wald", "newcombe", "newcombe_corrected"):
            assert -1 <= row[f"{name}_low"] <= row[f"{name}_high"] <= 1
