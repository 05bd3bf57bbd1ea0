"""Does a judge agree with human labels: overall, by slice, and against how far humans agree with each other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checks import is_tie, need_choice, need_columns, need_confidence, need_ids, need_one_per, need_resamples, need_unique, tidy
from ..plans.draws import label_totals, unit_key, unit_number, usable_interval
from ..results import NAN, JudgeValidation
from . import agreement as ag

#: Notes that tables of slices carry.
SLICE_ONE_ITEM = "one item, too few to measure agreement"
SLICE_NO_VARIANCE = "human and judge used one label throughout, so alpha has no denominator"


def labelled(labels: DataFrame, drop_ties: bool = False) -> DataFrame:
    """Rows with both labels; without those where either says tie, if ties are dropped."""
    rows = labels.where(F.col("human").isNotNull() & F.col("judge").isNotNull())
    return rows.where(~is_tie(F.col("human")) & ~is_tie(F.col("judge"))) if drop_ties else rows


def as_ratings(labels: DataFrame, *more: str) -> DataFrame:
    """Both labels of an item as ratings of two raters."""
    pair = F.array(F.struct(F.lit("human").alias("rater_id"), F.col("human").cast("string").alias("rating")), F.struct(F.lit("judge").alias("rater_id"), F.col("judge").cast("string").alias("rating")))
    return labels.select("item_id", *more, F.inline(pair))


def overall(labels: DataFrame, level: str = "nominal") -> DataFrame:
    """n_items, accuracy, alpha."""
    rows = labelled(labels)
    share = rows.agg(F.count("*").alias("n_items"), F.avg((F.col("human") == F.col("judge")).cast("double")).alias("accuracy"))
    return share.crossJoin(ag.alphas(_typed(as_ratings(rows), level), level).select("alpha"))


def slices(labels: DataFrame, level: str = "nominal") -> DataFrame:
    """slice, n_items, accuracy, alpha, note; a missing slice is one of its own."""
    rows = labelled(labels).withColumn("slice", F.col("slice").cast("string"))
    share = rows.groupBy("slice").agg(F.count("*").alias("n_items"), F.avg((F.col("human") == F.col("judge")).cast("double")).alias("accuracy"))
    keyed = as_ratings(rows, "slice").withColumn("slice_key", F.coalesce(F.concat(F.lit("s"), "slice"), F.lit("")))
    found = ag.alphas(_typed(keyed, level), level, ["slice_key"])
    note = F.when(F.col("n_items") < 2, SLICE_ONE_ITEM).when(F.col("n_values") <= 1, SLICE_NO_VARIANCE).otherwise("")
    return share.withColumn("slice_key", F.coalesce(F.concat(F.lit("s"), "slice"), F.lit(""))).join(found, "slice_key").select("slice", "n_items", "accuracy", "alpha", note.alias("note"))


def _typed(ratings: DataFrame, level: str) -> DataFrame:
    return ratings if level == "nominal" else ratings.withColumn("rating", ag.number_of(F.col("rating")))


def baseline_rules(baseline: DataFrame, judge: DataFrame, ties: str = "category") -> DataFrame:
    """item_id, cluster_id and the first rule that sets it aside: no_judge_label, too_few_humans, judge_tie; else kept."""
    drop = ties == "drop"
    decisive = ~is_tie(F.col("rating")) if drop else F.lit(True)
    humans = baseline.groupBy("item_id").agg(F.first("cluster_id").alias("cluster_id"), F.count_if(F.col("rating").isNotNull() & decisive).alias("n_humans"))
    judged = judge.select("item_id", "judge", F.lit(True).alias("known"))
    rule = (
        F.when(F.col("judge").isNull(), "no_judge_label")
        .when(F.col("n_humans") < 2, "too_few_humans")
        .when(F.lit(drop) & is_tie(F.col("judge")), "judge_tie")
        .otherwise("kept")
    )
    return humans.join(judged, "item_id", "left").select("item_id", "cluster_id", "judge", "n_humans", rule.alias("rule"))


def baseline_counts(baseline: DataFrame, judge: DataFrame, ties: str = "category") -> DataFrame:
    """(item_id, cluster_id, judge, rating, c): human labels by value of the kept items."""
    kept = baseline_rules(baseline, judge, ties).where("rule = 'kept'").select("item_id", "cluster_id", "judge")
    rows = baseline.where(F.col("rating").isNotNull()).select("item_id", F.col("rating").cast("string").alias("rating"))
    rows = rows.where(~is_tie(F.col("rating"))) if ties == "drop" else rows
    return rows.join(kept, "item_id").groupBy("item_id", "cluster_id", "judge", "rating").agg(F.count("*").alias("c"))


def cluster_sums(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By cluster: observed disagreements hh_o and jh_o; and by cluster and value: counts hh and jh.

    Human with human is an item's labels; judge with human has a unit of two for each human label.
    """
    item = counts.groupBy("item_id", "cluster_id").agg(F.sum("c").cast("double").alias("m"), F.sum(F.col("c") * F.col("c")).alias("c2"), F.sum(F.when(F.col("rating") != F.col("judge"), 2 * F.col("c")).otherwise(0)).cast("double").alias("jh_o"))
    observed = item.groupBy("cluster_id").agg(F.sum((F.col("m") * F.col("m") - F.col("c2")) / (F.col("m") - 1)).alias("hh_o"), F.sum("jh_o").alias("jh_o"))
    human = counts.select("cluster_id", F.col("rating").alias("v"), F.col("c").alias("hh"), F.col("c").alias("jh"))
    judge = counts.select("cluster_id", F.col("judge").alias("v"), F.lit(0).cast("long").alias("hh"), F.col("c").alias("jh"))
    return observed, human.unionByName(judge).groupBy("cluster_id", "v").agg(F.sum("hh").cast("double").alias("hh"), F.sum("jh").cast("double").alias("jh"))


def _alpha(o: str, n: str, squares: str):  # noqa: ANN202
    e = F.nullif(F.col(n) * F.col(n) - F.col(squares), F.lit(0.0))
    return 1 - (F.col(n) - 1) * F.col(o) / e


def two_alphas(observed: DataFrame, margins: DataFrame, by: list[str]) -> DataFrame:
    """judge_human, human_human and their difference from sums of cluster_sums by group."""
    m = margins.groupBy(*by).agg(F.sum("hh").alias("hn"), F.sum(F.col("hh") * F.col("hh")).alias("h2"), F.sum("jh").alias("jn"), F.sum(F.col("jh") * F.col("jh")).alias("j2"))
    both = observed.join(m, by) if by else observed.crossJoin(m)
    out = both.select(*by, _alpha("jh_o", "jn", "j2").alias("judge_human"), _alpha("hh_o", "hn", "h2").alias("human_human"))
    return out.withColumn("difference", F.col("judge_human") - F.col("human_human"))


def baseline_alphas(counts: DataFrame) -> DataFrame:
    observed, margins = cluster_sums(counts)
    return two_alphas(observed.agg(F.sum("hh_o").alias("hh_o"), F.sum("jh_o").alias("jh_o")), margins.groupBy("v").agg(F.sum("hh").alias("hh"), F.sum("jh").alias("jh")), [])


#: Which sums a cluster's cells hold: disagreements of humans and of the judge, counts by value of either.
HUMAN_O, JUDGE_O, HUMAN_C, JUDGE_C = 1, 2, 3, 4


def baseline_draws(counts: DataFrame, n_boot: int, seed: int | None, places: DataFrame | None = None) -> np.ndarray:
    """judge_human minus human_human of each resample of clusters, whatever the number of values.

    places (unit, place): clusters in order, for numpy's stream.
    """
    observed, margins = cluster_sums(counts)
    unit = (unit_number if places is None else unit_key)(F.col("cluster_id")).alias("unit")
    cell = lambda i, j, x: F.struct(i.cast("long").alias("i"), F.lit(j).cast("long").alias("j"), x.alias("x"))
    zero, value = F.lit(0), F.xxhash64("v")
    cells = observed.select(unit, F.inline(F.array(cell(zero, HUMAN_O, F.col("hh_o")), cell(zero, JUDGE_O, F.col("jh_o")))))
    cells = cells.unionByName(margins.select(unit, F.inline(F.array(cell(value, HUMAN_C, F.col("hh")), cell(value, JUDGE_C, F.col("jh"))))))
    totals, sides = label_totals(cells, n_boot, seed, places), []
    for o, c in ((JUDGE_O, JUDGE_C), (HUMAN_O, HUMAN_C)):
        n, squares = totals[c]
        e = n * n - squares
        sides.append(1 - (n - 1) * totals[o][0] / np.where(e == 0, np.nan, e))
    return sides[0] - sides[1]


def need_baseline(baseline: DataFrame, labels: DataFrame) -> None:
    """Refuses a human baseline that can't stand beside these labels."""
    need_columns(baseline, ["item_id", "cluster_id", "rater_id", "rating"], "human_baseline")
    if not baseline.limit(1).count():
        raise ValueError("human_baseline must not be empty")
    need_ids(baseline, ["item_id", "cluster_id", "rater_id"], "human_baseline")
    need_one_per(baseline, "item_id", "cluster_id", "human_baseline")
    need_unique(baseline.where(F.col("rating").isNotNull()), ["item_id", "rater_id"], "two labels of one rater on one item would count that opinion twice")
    if lost := baseline.join(labels.select("item_id"), "item_id", "left_anti").select("item_id").distinct().count():
        raise ValueError(f"human_baseline has {lost} item(s) that are not among the judged items")


def _baseline(baseline: DataFrame, labels: DataFrame, ties: str, confidence: float, n_boot: int, seed: int | None, order: Sequence[str] = ()) -> dict:
    judge = labels.select("item_id", F.col("judge").cast("string").alias("judge"))
    rules = {r.rule: r["count"] for r in baseline_rules(baseline, judge, ties).groupBy("rule").count().collect()}
    counts = baseline_counts(baseline, judge, ties)
    n_clusters = counts.select("cluster_id").distinct().count()
    out = {"baseline_n_items": rules.get("kept", 0), "baseline_n_clusters": n_clusters, "baseline_n_no_judge_label": rules.get("no_judge_label", 0), "baseline_n_too_few_humans": rules.get("too_few_humans", 0), "baseline_n_judge_ties": rules.get("judge_tie", 0)}
    if not n_clusters:
        return out
    point = baseline_alphas(counts).first()
    out |= {f"baseline_{k}": NAN if point[k] is None else point[k] for k in ("judge_human", "human_human", "difference")}
    if n_boot and n_clusters >= 2:
        places = None
        if order:
            need_columns(baseline, order, "human_baseline")
            rows = baseline.join(counts.select("item_id").distinct(), "item_id", "left_semi").where(F.col("rating").isNotNull())
            rows = rows.where(~is_tie(F.col("rating"))) if ties == "drop" else rows
            places = rows.groupBy(unit_key(F.col("cluster_id")).alias("unit")).agg(F.min(F.struct(*order)).alias("place"))
        difference = baseline_draws(counts, n_boot, seed, places)
        out["baseline_ci_low"], out["baseline_ci_high"], out["baseline_n_boot_usable"] = usable_interval(difference, confidence)
    return out


def judge_validation(labels: DataFrame, level: str = "nominal", confidence: float = 0.95, n_boot: int = 1000, seed: int | None = None, human_baseline: DataFrame | None = None, ties: str | None = None, order: Sequence[str] = ()) -> JudgeValidation:
    """labels: human, judge, and if there are, slice and item_id. human_baseline: item_id, cluster_id, rater_id, rating.

    order: columns of labels, and of the baseline if there is one, that number their rows. With it the bootstraps draw
    from numpy's stream: items and clusters by their first rows, and each slice, in order of first appearance, from a
    seed of its own. Without it items and clusters are told apart by their ids, slices by name; labels without item_id
    by where their rows lie, so that a seed repeats over the same files only.
    """
    need_choice("level", level, ag.LEVELS)
    need_confidence(confidence)
    need_resamples(n_boot, 0)
    need_columns(labels, ["human", "judge", *order], "labels")
    if human_baseline is None and ties is not None:
        raise ValueError("ties is about the human baseline; pass human_baseline too")
    if human_baseline is not None:
        if ties is None:
            raise ValueError("say what ties are in the human baseline: ties='category' or ties='drop'")
        need_choice("ties", ties, ("category", "drop"))
        if level != "nominal":
            raise ValueError("the human baseline is for nominal labels")
        need_columns(labels, ["item_id"], "labels with a human baseline")
        need_ids(labels, ["item_id"], "labels")
        need_unique(labels, ["item_id"], "the judge has one label an item")
    if "item_id" not in labels.columns:
        labels = labels.withColumn("item_id", unit_key(*map(F.col, order)) if order else F.monotonically_increasing_id())
    if human_baseline is not None:  # one spelling of a tie, so that two never count as a disagreement
        spell = lambda c: F.when(is_tie(F.col(c)), tidy(F.col(c))).otherwise(F.col(c).cast("string"))
        labels = labels.withColumns({"human": spell("human"), "judge": spell("judge")})
        human_baseline = human_baseline.withColumn("rating", spell("rating"))
    n_all, with_both = labels.count(), labelled(labels)
    kept = labelled(labels, ties == "drop").cache()
    try:
        n_both, n = with_both.count(), kept.count()
        if not n:
            raise ValueError("no item has a label on both sides")
        if human_baseline is not None:  # before any resample is drawn
            need_baseline(human_baseline, labels)
        found = overall(kept, level).first()
        ratings = ag.cleaned(as_ratings(kept, *(c for c in order if c != "item_id")), level, *order)
        low, high, usable = ag.alpha_interval(ratings, level, confidence, n_boot, seed, order) if n_boot and n >= 2 else (NAN, NAN, 0)
        more = _baseline(human_baseline, labels, ties, confidence, n_boot, seed, order) if human_baseline is not None else {}
        table = _slice_table(kept, level, confidence, n_boot, seed, order)
    finally:
        kept.unpersist()
    return JudgeValidation(NAN if found.alpha is None else found.alpha, low, high, found.accuracy, n, n_all - n_both, level, table, confidence, n_boot, usable, n_both - n, ties, **more)


def _slice_table(kept: DataFrame, level: str, confidence: float, n_boot: int, seed: int | None, order: Sequence[str]) -> pd.DataFrame:
    """A row a slice, least agreement first; equal ones in order of appearance, or by name without an order."""
    columns = ["slice", "n_items", "agreement", "ci_low", "ci_high", "accuracy", "note"]
    if "slice" not in kept.columns:
        return pd.DataFrame(columns=columns)
    kept = kept.withColumn("slice", F.col("slice").cast("string"))
    found = {r.slice: r for r in slices(kept, level).collect()}  # a row a slice
    seeds: list[int] = []
    if order:
        first = {r.slice: r.place for r in kept.groupBy("slice").agg(F.min(F.struct(*order)).alias("place")).collect()}
        names, rng = sorted(found, key=lambda s: tuple(first[s])), np.random.default_rng(seed)
        seeds = [int(rng.integers(2**32)) for _ in names]  # one for each slice, whether or not it is used
    else:
        names = sorted(found, key=str)
    draws = {}
    if n_boot and any(not r.note for r in found.values()):
        numbers = kept.sparkSession.createDataFrame([(name, k) for k, name in enumerate(names) if not found[name].note], "told string, slice_no long")
        rows = as_ratings(kept.join(numbers, F.col("slice").eqNullSafe(F.col("told"))), "slice_no", *(c for c in order if c != "item_id"))
        draws = ag.alpha_draws_by(_typed(rows, level), "slice_no", level, n_boot, seed, order, seeds)
    rows = []
    for k, name in enumerate(names):
        r = found[name]
        ci = usable_interval(draws[k], confidence)[:2] if k in draws else (NAN, NAN)
        rows.append((name, r.n_items, NAN if r.alpha is None else r.alpha, *ci, r.accuracy, r.note))
    return pd.DataFrame(rows, columns=columns).sort_values("agreement", na_position="last", kind="stable").reset_index(drop=True)
