"""One query an operator over the derived evaluation tables, all over whole tables.

Doubles are rounded to six places, so that engines that sum in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals, special
from ..functions.intervals import independent_difference, paired_difference
from ..functions.special import binomial_half_two_sided
from ..operators import agreement as ag
from ..operators import compare as cmp
from ..operators import judge as jd
from ..operators import length as ln
from ..operators import pairwise as pw
from ..operators import position as ps
from ..operators import power as pwr
from ..operators import relational as rel
from ..operators import scores as sc
from ..operators import studies as st
from ..operators.audit import audit
from ..sources import views as v
from .draws import resampled

Z = 1.959963984540054
SEED = 7


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places without a minus zero; whole numbers as longs."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double" or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(rows))


# scores


def q_score_wilson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sc.wilson_intervals(v.independent_scores(spark, sf), ["grp"]))


def q_score_t(spark: SparkSession, sf: str) -> DataFrame:
    """At the normal quantile, which t's has become at this many items."""
    stats = sc.t_intervals(v.independent_scores(spark, sf), ["grp"], "score_cont", Z)
    return rounded(stats.select("grp", "n", *(F.round(c, 1).alias(c) for c in ("mean", "sd", "se", "ci_low", "ci_high"))))


def q_score_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Of one group, by the method that the scores call for, by a bootstrap, and of prices in thousands by t."""
    urgent = v.independent_scores(spark, sf).where("grp = '1-URGENT'")
    found = [sc.score_ci(urgent), sc.score_ci(urgent, method="bootstrap", seed=SEED), sc.score_ci(urgent.withColumn("score", F.col("score_cont") / 1000), method="t")]
    return rounded(_frame(spark, [{"method": r.method, "n": r.n, "estimate": round(r.estimate, 4), "ci_low": round(r.ci_low, 4), "ci_high": round(r.ci_high, 4), "binary": r.binary} for r in found]))


def q_score_checks(spark: SparkSession, sf: str) -> DataFrame:
    s = v.independent_scores(spark, sf)
    long = s.select(F.inline(F.array(*(F.struct("grp", F.lit(n).alias("kind"), F.col(n).cast("double").alias("score")) for n in ("score", "score_cont")))))
    return sc.score_stats(long, ["grp", "kind"]).select("grp", "kind", "n", "binary", (F.col("low") == F.col("high")).alias("constant"))


# two systems


def q_mcnemar_counts(spark: SparkSession, sf: str) -> DataFrame:
    stats = cmp.discordance(v.paired_scores(spark, sf))
    b, c, n = F.col("n_a_only"), F.col("n_b_only"), F.col("n_discordant")
    statistic = F.when(n >= cmp.MCNEMAR_EXACT, F.pow(F.abs(b - c) - 1, F.lit(2)) / n)
    return rounded(stats.withColumn("statistic", statistic))


def q_mcnemar_exact(spark: SparkSession, sf: str) -> DataFrame:
    """A test a batch of orders, small enough for the exact one, and one a larger batch, which isn't."""
    both = [_batches(v.paired_scores(spark, sf), size).withColumn("size", F.lit(size)) for size in (40, 4000)]
    tests = cmp.mcnemar_tests(cmp.discordance(both[0].unionByName(both[1]), ["size", "batch"]))
    return rounded(tests.select("size", "batch", "n", "n_a_only", "n_b_only", "exact", "p_value"))


def q_tango_ci(spark: SparkSession, sf: str) -> DataFrame:
    r = cmp.discordance(v.paired_scores(spark, sf)).first()
    low, high = paired_difference(r.n_a_only, r.n_b_only, r.n, 0.95)
    return rounded(_frame(spark, [{"difference": r.difference, "ci_low": low, "ci_high": high}]))


def q_score_diff_ci(spark: SparkSession, sf: str) -> DataFrame:
    g = {r.grp: r for r in cmp.group_stats(v.independent_scores(spark, sf)).collect()}
    a, b = g["1-URGENT"], g["5-LOW"]
    low, high = independent_difference(a.total, a.n, b.total, b.n, 0.95)
    return rounded(_frame(spark, [{"difference": a.total / a.n - b.total / b.n, "ci_low": low, "ci_high": high}]))


def _two(stats: DataFrame) -> DataFrame:
    a, b = (stats.where(F.col("grp") == g).drop("grp") for g in ("1-URGENT", "5-LOW"))
    return a.select(*(F.col(c).alias(f"{c}1") for c in a.columns)).crossJoin(b.select(*(F.col(c).alias(f"{c}2") for c in b.columns)))


def q_two_prop_z_stat(spark: SparkSession, sf: str) -> DataFrame:
    two = _two(cmp.group_stats(v.independent_scores(spark, sf)))
    z = cmp.pooled_z(F.col("total1"), F.col("n1"), F.col("total2"), F.col("n2"))
    return rounded(two.select("n1", "n2", (F.col("mean1") - F.col("mean2")).alias("difference"), z.alias("z")))


def q_welch_stats(spark: SparkSession, sf: str) -> DataFrame:
    two = _two(cmp.group_stats(v.independent_scores(spark, sf), score="score_cont"))
    e1, e2 = F.col("variance1") / F.col("n1"), F.col("variance2") / F.col("n2")
    df = F.pow(e1 + e2, F.lit(2)) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    return rounded(two.select(F.round(F.col("mean1") - F.col("mean2"), 2).alias("difference"), F.round(F.sqrt(e1 + e2), 3).alias("se"), F.round(df, 3).alias("df")))


def q_wilcoxon_ranks(spark: SparkSession, sf: str) -> DataFrame:
    ranks = cmp.signed_ranks(_cents(v.paired_scores(spark, sf)))
    return rounded(cmp.rank_sums(ranks).select(F.col("n").cast("long").alias("n"), "w_positive", "w_negative", "tie_correction"))


def _cents(pairs: DataFrame) -> DataFrame:
    """Continuous scores in whole hundredths, so that equal differences are equal in every engine."""
    return pairs.select("item_id", F.round(F.col("a_cont").cast("double") * 100).alias("a"), F.round(F.col("b_cont").cast("double") * 100).alias("b"))


def _walsh(spark: SparkSession, sf: str) -> DataFrame:
    d = _cents(v.paired_scores(spark, sf)).select((F.col("a") - F.col("b")).alias("d")).where("d <> 0")
    return cmp.walsh(d)


def q_walsh_averages(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_walsh(spark, sf).select("w", F.col("n").cast("long").alias("n")))


def q_hodges_lehmann(spark: SparkSession, sf: str) -> DataFrame:
    r = cmp.compare_paired(_cents(v.paired_scores(spark, sf)), method="wilcoxon")
    return rounded(_frame(spark, [{"n": r.n, "difference": r.difference, "ci_low": r.ci_low, "ci_high": r.ci_high}]))


@contextmanager
def _kept(*rows: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """rows, made once for all passes over them."""
    for x in rows:
        x.persist()
    try:
        yield rows
    finally:
        for x in rows:
            x.unpersist()


def _compared(spark: SparkSession, *found) -> DataFrame:  # noqa: ANN002
    return rounded(_frame(spark, [{"method": r.method, "n": r.n, "difference": r.difference, "ci_low": r.ci_low, "ci_high": r.ci_high, "p_value": r.p_value, "binary": r.binary, "paired": r.paired} for r in found]))


def q_compare_paired(spark: SparkSession, sf: str) -> DataFrame:
    """McNemar's test on the pass rates; a bootstrap and signed ranks on the continuous scores in hundredths."""
    with _kept(v.paired_scores(spark, sf)) as (pairs,):
        cents = _cents(pairs)
        return _compared(spark, cmp.compare_paired(pairs), cmp.compare_paired(cents, method="bootstrap", seed=SEED), cmp.compare_paired(cents, method="wilcoxon"))


def q_compare_independent(spark: SparkSession, sf: str) -> DataFrame:
    """The score interval with its z test, a bootstrap, and on prices in millions Welch's interval."""
    with _kept(v.independent_scores(spark, sf)) as (rows,):
        s = rows.withColumn("millions", F.col("score_cont") / 1e6)
        a, b = (s.where(F.col("grp") == g) for g in ("1-URGENT", "5-LOW"))
        welch = cmp.compare_independent(a, b, method="t", score="millions")
        return _compared(spark, cmp.compare_independent(a, b), cmp.compare_independent(a, b, method="bootstrap", seed=SEED), welch)


def q_signed_null(spark: SparkSession, sf: str) -> DataFrame:
    """The exact distribution of the signed-rank sum for each number of differences that batches of orders have, and what its interval leaves out at either end."""
    differing = _batches(_cents(v.paired_scores(spark, sf)), 12).groupBy("batch").agg(F.count_if(F.col("a") != F.col("b")).alias("n"))
    sizes = differing.where("n > 0").groupBy("n").agg(F.count("*").alias("n_batches"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for n, many in zip(part["n"], part["n_batches"], strict=True):
                counts = cmp.null_ranks(int(n))
                yield pd.DataFrame({"n": n, "n_batches": many, "sum": range(len(counts)), "patterns": counts, "trim": cmp.signed_trim(int(n), 0.95, True)})

    return sizes.mapInPandas(rows, "n long, n_batches long, sum long, patterns long, trim long")


# power


def _batches(rows: DataFrame, size: int) -> DataFrame:
    """rows with the batch of items that each is in."""
    return rows.withColumn("batch", F.floor(F.col("item_id") / size).cast("long"))


def _designs(spark: SparkSession, sf: str) -> DataFrame:
    """Each batch of orders as a pilot study: its items, first pass rate and discordance."""
    pairs = _batches(v.paired_scores(spark, sf), 400)
    return pairs.groupBy("batch").agg(F.count("*").alias("n"), F.avg(F.col("a").cast("double")).alias("baseline"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("discordance_rate"))


def q_min_n_grid(spark: SparkSession, sf: str) -> DataFrame:
    """What fifteen differences would take after each pilot."""
    return rounded(pwr.size_grid(_designs(spark, sf).drop("n").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(15)))).withColumn("mde", F.col("step") / 50).drop("step")))


def q_power_paired_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pwr.reach_grid(_designs(spark, sf).drop("baseline")))


def q_power(spark: SparkSession, sf: str) -> DataFrame:
    """What pilots' sizes could see of the reference difference, paired and independent, and the size it takes."""
    return rounded(pwr.power_table(_designs(spark, sf)).drop("reach"))


def q_power_indep_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pwr.power_table(_designs(spark, sf)).select("batch", "n", "baseline", F.col("reach").alias("difference")))


def q_special_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Of each pilot's discordance: its normal, chi-squared and t tails; of its passes the exact binomial interval, and t's quantile back from its tail."""
    pairs = _batches(v.paired_scores(spark, sf), 400)
    stats = cmp.discordance(pairs, ["batch"]).join(pairs.groupBy("batch").agg(F.sum("a").alias("k")), "batch").where("n > 1").select("batch", "n", "k", ((F.col("n_a_only") - F.col("n_b_only")) / F.sqrt(F.greatest("n_discordant", F.lit(1)))).alias("z"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            exact = [intervals.clopper_pearson(int(k), int(n), 0.95) for k, n in zip(part["k"], part["n"], strict=True)]
            yield part.assign(
                normal=[special.normal_two_sided(z) for z in part["z"]], chi2=[special.chi2_one_sf(z * z) for z in part["z"]],
                t=[special.t_two_sided(z, n - 1) for z, n in zip(part["z"], part["n"], strict=True)],
                back=[special.t_two_sided(special.t_quantile(0.975, n - 1), n - 1) for n in part["n"]],
                low=[x[0] for x in exact], high=[x[1] for x in exact],
            )

    return rounded(stats.mapInPandas(rows, "batch long, n long, k long, z double, normal double, chi2 double, t double, back double, low double, high double"))


# agreement


def _alpha(level: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = v.ratings(spark, sf)
        rows = rows.select("item_id", "rater_id", "rating") if level == "nominal" else v.numeric(rows)
        return rounded(ag.alphas(rows, level))

    return query


def q_alpha_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ag.alphas(v.sparse_ratings(spark, sf)))


def q_item_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ag.item_disagreement(v.ratings(spark, sf)))


def q_rater_dropout(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ag.rater_dropout(v.ratings(spark, sf).select("item_id", "rater_id", "rating")))


def q_rater_dropout_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ag.rater_dropout(v.numeric(v.ratings(spark, sf)), "ordinal"))


def q_alpha_one_value(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings that are all one value have no alpha."""
    return rounded(ag.alphas(v.ratings(spark, sf).select("item_id", "rater_id", F.lit("same").alias("rating"))))


def q_ratings_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Of ratings with gaps and of labels that are numbers: what agreement reads."""
    rows = v.ratings(spark, sf)
    gaps = ag.cleaned(rows.select("item_id", "rater_id", F.nullif("rating", F.lit("view")).alias("rating")), "nominal")
    numbers = ag.cleaned(rows.select("item_id", "rater_id", F.concat(F.col("rating_num").cast("string"), F.lit(".50")).alias("rating")), "interval")
    return gaps.select("rating").unionByName(numbers.select(F.col("rating").cast("string").alias("rating"))).groupBy("rating").agg(F.count("*").alias("n"))


def q_cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    r = v.ratings(spark, sf)
    pair = r.where("rater_id = 'h0'").select("item_id", F.col("rating").alias("r1")).join(r.where("rater_id = 'h1'").select("item_id", F.col("rating").alias("r2")), "item_id")
    return rounded(ag.cohen_stats(pair))


def q_fleiss_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ag.fleiss_stats(v.ratings(spark, sf)))


def _agreed(level: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = v.ratings(spark, sf)
        r = ag.rater_agreement(rows.select("item_id", "rater_id", "rating") if level == "nominal" else v.numeric(rows), level, seed=SEED)
        columns = ("level", "alpha", "ci_low", "ci_high", "n_items", "n_raters", "n_overlapping_items", "n_boot", "n_boot_usable", "one_value")
        return rounded(_frame(spark, [{c: getattr(r, c) for c in columns}]))

    return query


# judge


def q_judge_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(jd.overall(v.judge_labels(spark, sf)))


def q_judge_slices(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(jd.slices(v.judge_labels(spark, sf)))


def q_baseline_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = jd.baseline_rules(v.baseline(spark, sf), v.baseline_judge(spark, sf))
    return rules.groupBy("rule").agg(F.count("*").alias("n_items"), F.count_distinct("cluster_id").alias("n_clusters"))


def q_baseline_rules_drop(spark: SparkSession, sf: str) -> DataFrame:
    """The same where clicks are ties and ties are dropped."""
    tie = lambda c: F.when(F.col(c) == "click", " Tie").otherwise(F.col(c)).alias(c)
    rules = jd.baseline_rules(v.baseline(spark, sf).select("item_id", "cluster_id", "rater_id", tie("rating")), v.baseline_judge(spark, sf).select("item_id", tie("judge")), "drop")
    return rules.groupBy("rule").agg(F.count("*").alias("n_items"), F.sum("n_humans").alias("n_humans"))


def _base_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jd.baseline_counts(v.baseline(spark, sf), v.baseline_judge(spark, sf))


def q_baseline_alphas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(jd.baseline_alphas(_base_counts(spark, sf)))


def q_judge_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The judge against how far humans agree, over resampled clusters; a human label is that of rater h0."""
    h0 = v.ratings(spark, sf).where("rater_id = 'h0'").select("item_id", F.col("rating").alias("human"))
    r = jd.judge_validation(v.baseline_judge(spark, sf).join(h0, "item_id", "left"), seed=SEED, human_baseline=v.baseline(spark, sf), ties="category")
    columns = ("n_items", "n_dropped", "accuracy", "agreement", "baseline_judge_human", "baseline_human_human", "baseline_difference", "baseline_ci_low", "baseline_ci_high", "baseline_n_items", "baseline_n_clusters", "baseline_n_too_few_humans", "baseline_n_boot_usable")
    return rounded(_frame(spark, [{c: getattr(r, c) for c in columns}]))


def _judged(spark: SparkSession, sf: str):  # noqa: ANN202
    return jd.judge_validation(v.judge_labels(spark, sf), seed=SEED)


def q_judge_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The overall row and a row a slice, each with its bootstrap interval, or with the reason for none."""
    r = _judged(spark, sf)
    rows = [{"slice": "(all)", "n_items": r.n_items, "agreement": r.agreement, "ci_low": r.ci_low, "ci_high": r.ci_high, "accuracy": r.accuracy}]
    rows[0]["note"] = ""
    table = pd.DataFrame(rows + r.by_slice[list(rows[0])].to_dict("records"))
    return rounded(spark.createDataFrame([tuple(None if x != x else x for x in row) for row in table.itertuples(index=False)], "slice string, n_items long, agreement double, ci_low double, ci_high double, accuracy double, note string"))


# position and length


def q_position_design(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [ps.design(v.positions(spark, sf, pair)).withColumn("pairs", F.lit(pair)) for pair in ("pair_id", "item_id")]
    return kinds[0].unionByName(kinds[1])


def q_position_randomised(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.shown_first(v.positions(spark, sf, "pair_id")).withColumn("rate", F.col("n_a_wins") / F.col("n_decisive")))


def q_position_couples(spark: SparkSession, sf: str) -> DataFrame:
    return ps.couples(v.positions(spark, sf, "item_id"))


def q_position_bias(spark: SparkSession, sf: str) -> DataFrame:
    """Of judgements in random order, and of pairs judged both ways, with exact intervals and p-values."""
    found = [ps.position_bias(v.positions(spark, sf, pair), order="seq") for pair in ("pair_id", "item_id")]
    columns = ("design", "estimate", "ci_low", "ci_high", "p_value", "n_a_wins", "n_decisive", "n_pairs", "n_pairs_scored", "n_judgements", "n_ties")
    return rounded(_frame(spark, [{c: getattr(r, c) for c in columns} for r in found]))


def q_position_exact_p(spark: SparkSession, sf: str) -> DataFrame:
    c = ps.couple_counts(v.positions(spark, sf, "item_id")).first()
    return rounded(_frame(spark, [{"n_flipped": c.n_flipped, "n_first": c.n_first, "p_value": binomial_half_two_sided(c.n_first, c.n_flipped) if c.n_flipped else None}]))


def q_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = ln.predictors(v.lengths(spark, sf))
    fits = [ln.outcome_stats(rows, f"x{k}", f"y{k}").withColumn("fit", F.lit(name)) for k, name in ((1, "preference"), (2, "disagreement"))]
    return rounded(fits[0].unionByName(fits[1]))


def q_length_fit(spark: SparkSession, sf: str) -> DataFrame:
    found = ln.length_bias(v.lengths(spark, sf)).to_df(spark)
    return rounded(found.select("n", "n_disagreements", "longer_rate", *(F.round(f"{fit}{c}", 5).alias(f"{fit}{c}") for fit in ("", "disagreement_") for c in ("coefficient", "ci_low", "ci_high"))))


# leaderboard


def q_bt_credit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pw.credits(pw.cleaned(v.leaderboard(spark, sf))))


def q_bt_totals_reference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pw.totals(pw.cleaned(v.leaderboard(spark, sf))))


def _board(spark: SparkSession, sf: str, n_boot: int = 0):  # noqa: ANN202
    return pw.bradley_terry(v.leaderboard(spark, sf), n_boot=n_boot, seed=SEED)


def q_bt_components(spark: SparkSession, sf: str) -> DataFrame:
    """Of the board, and of three islands of it: models named apart by the user's number."""
    rows, out = v.leaderboard(spark, sf), []
    island = lambda c: F.when(F.col(c) != "tie", F.concat(c, F.lit("@"), (F.col("item_id") % 3).cast("string"))).otherwise(F.col(c))
    for name, board in (("all", rows), ("islands", rows.withColumns({c: island(c) for c in ("model_a", "model_b", "winner")}))):
        found = pw.bradley_terry(board, n_boot=0).comparable_groups
        out += [{"board": name, "model": m, "group_first": g[0], "size": len(g)} for g in found for m in g]
    return rounded(_frame(spark, out))


def q_bt_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_frame(spark, _board(spark, sf).ratings[["model", "rating", "n_comparisons"]].to_dict("records")).withColumn("rating", F.round("rating", 5)))


def q_bt_win_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = _board(spark, sf).win_matrix
    return rounded(_frame(spark, [{"model_a": a, "model_b": b, "p": m.loc[a, b]} for a in m.index for b in m.columns if a != b]).withColumn("p", F.round("p", 5)))


def q_bt_credit_drop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pw.credits(pw.cleaned(v.leaderboard(spark, sf)), "drop"))


def q_bt_boot_credit(spark: SparkSession, sf: str) -> DataFrame:
    """What the bootstrap over items sums: credits by resample and pair of models."""
    rows = pw.cleaned(v.leaderboard(spark, sf))
    models = sorted(r.model for r in pw.totals(rows).collect())
    cells, _ = pw.credit_cells(rows, "split", models, "items")
    out, first = [], 0
    for labels, sums in resampled(cells, 1000, SEED):
        b = np.repeat(np.arange(first, first + len(sums)), len(labels))
        out.append(pd.DataFrame({"b": b, "i": [models[k] for k in labels[:, 0]] * len(sums), "j": [models[k] for k in labels[:, 1]] * len(sums), "credit": sums.ravel()}))
        first += len(sums)
    return rounded(spark.createDataFrame(pd.concat(out)).where("credit > 0"))


def q_bt_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every gap with its bootstrap interval, and whether it is told from zero."""
    pairs = _board(spark, sf, 1000).pairs
    return rounded(spark.createDataFrame(pairs).select("model_a", "model_b", *(F.round(c, 4).alias(c) for c in ("difference", "ci_low", "ci_high", "p_a_beats_b")), "n_head_to_head", "separable"))


def q_bt_rating_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rated = _board(spark, sf, 1000).ratings
    return rounded(spark.createDataFrame(rated).select("model", *(F.round(c, 4).alias(c) for c in ("rating", "ci_low", "ci_high"))))


def q_bt_ends(spark: SparkSession, sf: str) -> DataFrame:
    """A board on which the later name always wins has no ratings: its first model by wins and its last."""
    r = pw.bradley_terry(v.leaderboard(spark, sf).withColumn("winner", F.greatest("model_a", "model_b")), n_boot=0)
    return _frame(spark, [{"undefeated": ",".join(r.undefeated), "winless": ",".join(r.winless), "connected": r.connected, "n_rated": int(r.ratings["rating"].notna().sum())}])


def q_bt_elo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_frame(spark, pw.to_elo(_board(spark, sf)).ratings[["model", "rating"]].to_dict("records")).withColumn("rating", F.round("rating", 3)))


# audit and the steps around


def q_audit(spark: SparkSession, sf: str) -> DataFrame:
    pairs = v.paired_scores(spark, sf)
    scores = pairs.select(F.inline(F.array(*(F.struct(F.lit(s).alias("system"), "item_id", F.col(s).alias("score")) for s in ("a", "b")))))
    report = audit(scores=scores, comparisons=v.positions(spark, sf, "pair_id"), ratings=v.ratings(spark, sf).select("item_id", "rater_id", "rating"), labels=v.judge_labels(spark, sf), preferences=v.lengths(spark, sf), config={"effect_of_interest": 0.05, "seed": SEED}, order="seq")
    return _frame(spark, [{"at": k, "check": f.check, "severity": f.severity, "title": f.title} for k, f in enumerate(report.findings)])


def q_raw_pair_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rel.pair_agreement(v.ratings(spark, sf), "item_id", "rating"))


def q_plurality(spark: SparkSession, sf: str) -> DataFrame:
    return rel.plurality(v.ratings(spark, sf), "item_id", "rating")


def q_first_vote(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.leaderboard(spark, sf).select("item_id", "model_a", "model_b", "seq", "winner")
    return rel.first_rows(rows, ["item_id", "model_a", "model_b"], ["seq"])


def q_multi_judge_units(spark: SparkSession, sf: str) -> DataFrame:
    return rel.with_raters(v.sparse_ratings(spark, sf), "item_id", "rater_id").select("item_id", "rater_id", "rating")


def q_join_judge(spark: SparkSession, sf: str) -> DataFrame:
    joined = rel.join_one(v.baseline(spark, sf), v.baseline_judge(spark, sf), ["item_id"])
    return joined.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count("judge").alias("n_judged"), F.count_if(F.col("judge") == F.col("rating")).alias("n_same"))


def q_join_inner(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of items that the judge has labelled, kept by an inner join."""
    joined = rel.join_one(v.sparse_ratings(spark, sf), v.baseline_judge(spark, sf).where("judge <> 'view'"), ["item_id"], "inner")
    return joined.groupBy("judge").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("n_items"))


def q_winner_names(spark: SparkSession, sf: str) -> DataFrame:
    """Winners told by side, turned to names again."""
    rows = v.leaderboard(spark, sf)
    side = F.when(F.col("winner") == F.col("model_a"), "model_a").when(F.col("winner") == F.col("model_b"), "model_b").otherwise("tie (both bad)")
    return rows.select(rel.winner_name(side, F.col("model_a"), F.col("model_b")).alias("winner")).groupBy("winner").agg(F.count("*").alias("n"))


def q_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """What the operators refuse, and the reason that each gives, with how many rows of the tables it names."""
    with _kept(v.ratings(spark, sf), v.leaderboard(spark, sf), v.baseline_judge(spark, sf)) as (rated, board, judged):
        return _refused(spark, sf, rated, board, judged)


def _refused(spark: SparkSession, sf: str, rated: DataFrame, board: DataFrame, judged: DataFrame) -> DataFrame:
    """q_refusals, from views that several cases read; those of positions and of the baseline are made of these and kept with them."""
    ratings, scores, labels = rated.select("item_id", "rater_id", "rating"), v.independent_scores(spark, sf), v.judge_labels(spark, sf)
    shown, base = v.positions(spark, sf, "pair_id"), v.baseline(spark, sf)
    told = judged.withColumn("human", F.col("judge"))
    cases = {
        "score not finite": lambda: sc.score_ci(scores.withColumn("score", F.when(F.col("score") == 1, float("nan")).otherwise(0.0))),
        "wilson of prices": lambda: sc.score_ci(scores, method="wilson", score="score_cont"),
        "t of passes": lambda: sc.score_ci(scores, method="t"),
        "confidence of one": lambda: sc.score_ci(scores, confidence=1.0),
        "no resamples": lambda: sc.score_ci(scores, n_boot=0),
        "method unknown": lambda: cmp.compare_paired(v.paired_scores(spark, sf), method="sign"),
        "mcnemar of cents": lambda: cmp.compare_paired(_cents(v.paired_scores(spark, sf)), method="mcnemar"),
        "score interval of prices": lambda: cmp.compare_independent(scores, scores, method="score", score="score_cont"),
        "rating twice": lambda: ag.rater_agreement(ratings.unionByName(ratings)),
        "labels as numbers": lambda: ag.rater_agreement(ratings, "ordinal"),
        "rater missing": lambda: ag.rater_agreement(ratings.withColumn("rater_id", F.nullif("rater_id", F.lit("h0")))),
        "no ratings": lambda: ag.rater_agreement(ratings.where("false")),
        "ties without baseline": lambda: jd.judge_validation(labels, ties="drop"),
        "baseline without ties": lambda: jd.judge_validation(told, human_baseline=base),
        "ordinal baseline": lambda: jd.judge_validation(told, "ordinal", human_baseline=base, ties="drop"),
        "item in two clusters": lambda: jd.judge_validation(told, human_baseline=base.withColumn("cluster_id", F.col("rater_id")), ties="drop"),
        "baseline beyond the judged": lambda: jd.judge_validation(told.where("item_id % 2 = 0"), human_baseline=base, ties="drop"),
        "winner not compared": lambda: pw.bradley_terry(board.withColumn("winner", F.lit("nobody"))),
        "model against itself": lambda: pw.bradley_terry(board.withColumn("model_b", F.col("model_a"))),
        "model called tie": lambda: pw.bradley_terry(board.withColumn("model_a", F.lit(" TIE "))),
        "davidson ties": lambda: pw.bradley_terry(board, ties="davidson"),
        "winner not shown": lambda: ps.position_bias(shown.withColumn("winner", F.lit("nobody"))),
        "pair missing": lambda: ps.position_bias(shown.withColumn("pair_id", F.lit(None).cast("long"))),
        "power under alpha": lambda: pwr.min_sample_size(0.1, power=0.01),
        "effect above discordance": lambda: pwr.min_sample_size(0.4, discordance_rate=0.3),
        "half an item": lambda: pwr.detectable_effect(10.5),
        "audit of nothing": lambda: audit(),
        "field unknown": lambda: audit(ratings=ratings, config={"seeds": 1}),
        "many rows a key": lambda: rel.join_one(ratings, ratings, ["item_id"]),
    }

    def refusal(case: Callable[[], object]) -> str | None:
        try:
            case()
        except (ValueError, NotImplementedError) as e:
            return str(e)
        return None

    return _frame(spark, [{"case": name, "refusal": refusal(case)} for name, case in cases.items()])


def q_codings(spark: SparkSession, sf: str) -> DataFrame:
    return rel.codings(v.leaderboard(spark, sf)).groupBy("by_name", "by_alphabet", "by_place").agg(F.count("*").alias("n"))


def q_unordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    low, high = rel.unordered(F.col("model_a"), F.col("model_b"))
    return v.leaderboard(spark, sf).groupBy(low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"))


def q_funnel(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.judge_labels(spark, sf)
    return rel.funnel(rows, {"all": F.lit(True), "judged good": F.col("judge") == 1, "human agrees": F.col("human") == 1, "english": F.col("slice") == "en"})


def q_design_effect(spark: SparkSession, sf: str) -> DataFrame:
    boards = [spark.createDataFrame(pw.bradley_terry(v.leaderboard(spark, sf), n_boot=1000, seed=SEED, resample=r).pairs) for r in ("items", "comparisons")]
    return rounded(rel.width_ratios(*boards))


def q_plain_paired_intervals(spark: SparkSession, sf: str) -> DataFrame:
    pairs = v.paired_scores(spark, sf)
    stats = cmp.discordance(pairs).crossJoin(pairs.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both")))
    return rounded(rel.plain_paired_intervals(stats))


def q_bt_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps told from zero by their own interval, and by intervals of ratings that do not overlap."""
    board = _board(spark, sf, 1000)
    return rel.apart(*map(spark.createDataFrame, (board.pairs, board.ratings))).select("model_a", "model_b", "separable", "apart")


def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How often Wilson's interval of a batch of orders has the whole group's rate."""
    return rounded(st.score_coverage(_batches(v.independent_scores(spark, sf), 400), ["grp"]))


def q_coverage_paired(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.paired_coverage(_batches(v.paired_scores(spark, sf), 400)))


def q_coverage_two_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.two_sample_coverage(_batches(v.independent_scores(spark, sf), 2000), ("1-URGENT", "5-LOW"), seed=SEED))


def q_coverage_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Of boards of fifteen users each against the board of all."""
    return rounded(st.board_coverage(_batches(v.leaderboard(spark, sf), 15), seed=SEED))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k.startswith("q_")} | {f"q_alpha_{level}": _alpha(level) for level in ag.LEVELS} | {f"q_rater_agreement_{level}": _agreed(level) for level in ag.LEVELS}
