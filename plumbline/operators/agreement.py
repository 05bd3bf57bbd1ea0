"""Agreement between raters: Krippendorff's alpha with its diagnostics, and the kappas.

All of it reads each item through the counts of its ratings by value. Ordinal alpha is interval alpha on mid-ranks
(a value's mid-rank is the ratings below it and half of its own), so every level is sums of counts, values and squares.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checks import need_choice, need_columns, need_confidence, need_none, need_resamples, need_unique, null_counts
from ..plans.draws import SUMS, WIDE, as_drawn, label_sums, label_totals, polynomials, resampled, running, some_seed, times_of, unit_key, unit_number, usable_interval, with_draws, with_draws_by
from ..plans.stream import numbered
from ..results import NAN, AgreementResult, KappaResult

LEVELS = ("nominal", "ordinal", "interval")
RATINGS = ["item_id", "rater_id", "rating"]
#: Fixed sentences that tables carry.
SINGLE_RATER = "only one rater left, nothing to compare"
NO_OVERLAP = "no item left with two or more ratings"
NO_VARIANCE = "remaining raters agreed everywhere, so alpha has no denominator"
ONE_ITEM = "only one item left with two or more ratings"


def number_of(label: Column) -> Column:
    """The double that a label spells, with or without underscores between digits; null for any other label."""
    text = F.regexp_replace(label, r"(?<=\d)_(?=\d)", "")
    spelled = text.rlike(r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$")
    return F.when(spelled, F.btrim(text, F.lit(" \t\r\n")).try_cast("double"))


def cleaned(ratings: DataFrame, level: str, *more: str) -> DataFrame:
    """(item_id, rater_id, rating, more): rated rows, numbers as doubles if all are, else labels, which only nominal takes."""
    need_choice("level", level, LEVELS)
    need_columns(ratings, [*RATINGS, *more], "ratings")
    number = number_of(F.col("rating")) if dict(ratings.dtypes)["rating"] == "string" else F.col("rating").cast("double")
    rows = ratings.select(*RATINGS, *(m for m in more if m not in RATINGS)).where(F.col("rating").isNotNull())
    if dict(ratings.dtypes)["rating"] in ("double", "float"):
        rows = rows.where(~F.isnan("rating"))
    n, numeric, *lost = rows.agg(F.count("*"), F.bool_and(number.isNotNull()), *null_counts(RATINGS[:2])).first()
    if not n:
        raise ValueError("ratings must not be empty")
    need_none(RATINGS[:2], lost, "ratings")
    need_unique(rows, RATINGS[:2], "two ratings of one rater on one item would count that opinion twice")
    if not numeric and level != "nominal":
        raise ValueError(f"level={level!r} needs numeric ratings; map the labels to numbers or use level='nominal'")
    rows = rows.withColumn("rating", number if numeric else F.col("rating").cast("string"))
    return rows.where(~F.isnan("rating")) if numeric else rows


def value_counts(ratings: DataFrame, by: Sequence[str] = (), item: Sequence[str] = ("item_id",)) -> DataFrame:
    """(by, item, rating, c) of items with two ratings or more."""
    keys = [*by, *item]
    counts = ratings.where(F.col("rating").isNotNull()).groupBy(*keys, "rating").agg(F.count("*").alias("c"))
    return counts.withColumn("m", F.sum("c").over(Window.partitionBy(*keys))).where("m >= 2")


def positions(counts: DataFrame, level: str, by: Sequence[str] = ()) -> DataFrame:
    """counts with x, where a rating lies: itself, or its mid-rank among the ratings of its group."""
    if "x" in counts.columns:  # placed before
        return counts
    if level == "nominal":
        return counts.withColumn("x", F.lit(0.0))
    if level == "interval":
        return counts.withColumn("x", F.col("rating").cast("double"))
    marginal = counts.groupBy(*by, "rating").agg(F.sum("c").alias("g"))
    if by:  # a group has a row a value
        before = F.coalesce(F.sum("g").over(Window.partitionBy(*by).orderBy("rating").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = marginal.withColumn("before", before)
    else:
        ranks = running(marginal, "rating", "g", "before")
    return counts.join(ranks.select(*by, "rating", (F.col("before") + F.col("g") / 2).alias("x")), [*by, "rating"])


def spread(level: str, m: Column, c2: Column, s1: Column, s2: Column) -> Column:
    """The squared distances of all ordered pairs among m ratings."""
    return m * m - c2 if level == "nominal" else 2 * (m * s2 - s1 * s1)


def unit_stats(counts: DataFrame, level: str, by: Sequence[str] = (), item: Sequence[str] = ("item_id",)) -> DataFrame:
    """By item: m ratings and the observed disagreement `o`, the spread over m - 1."""
    c, x = F.col("c"), F.col("x")
    sums = positions(counts, level, by).groupBy(*by, *item).agg(F.sum(c).cast("double").alias("m"), F.sum(c * c).cast("double").alias("c2"), F.sum(c * x).alias("s1"), F.sum(c * x * x).alias("s2"))
    return sums.select(*by, *item, "m", (spread(level, F.col("m"), F.col("c2"), F.col("s1"), F.col("s2")) / (F.col("m") - 1)).alias("o"))


def expected(counts: DataFrame, level: str, by: Sequence[str] = ()) -> DataFrame:
    """By group: n ratings, the spread `e` of all of them, and the number of values."""
    marginal = positions(counts, level, by).groupBy(*by, "rating", "x").agg(F.sum("c").cast("double").alias("g"))
    g, x = F.col("g"), F.col("x")
    sums = marginal.groupBy(*by).agg(F.sum(g).alias("n"), F.sum(g * g).alias("g2"), F.sum(g * x).alias("s1"), F.sum(g * x * x).alias("s2"), F.count("*").alias("n_values"))
    e = F.when(F.col("n_values") <= 1, 0.0).otherwise(spread(level, F.col("n"), F.col("g2"), F.col("s1"), F.col("s2")))
    return sums.select(*by, "n", e.alias("e"), "n_values")


def alphas(ratings: DataFrame, level: str = "nominal", by: Sequence[str] = (), item: Sequence[str] = ("item_id",)) -> DataFrame:
    """By group: alpha (null if undefined), n_units, n_ratings, n_values."""
    counts = positions(value_counts(ratings, by, item), level, by)
    units = unit_stats(counts, level, by, item).groupBy(*by).agg(F.sum("o").alias("o"), F.count("*").alias("n_units"))
    chance = expected(counts, level, by)
    both = units.join(chance, list(by)) if by else units.crossJoin(chance)
    alpha = F.when(F.col("n_units") >= 2, 1 - (F.col("n") - 1) * F.col("o") / F.nullif(F.col("e"), F.lit(0.0)))
    return both.select(*by, alpha.alias("alpha"), "n_units", F.col("n").cast("long").alias("n_ratings"), "n_values")


def item_disagreement(ratings: DataFrame, level: str = "nominal") -> DataFrame:
    """item_id, n_ratings, disagreement (mean squared distance of two of its ratings), vs_chance."""
    counts = positions(value_counts(ratings), level)
    chance = expected(counts, level).select((F.col("e") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0.0))).alias("chance"))
    d = F.col("o") / F.col("m")
    return unit_stats(counts, level).crossJoin(F.broadcast(chance)).select("item_id", F.col("m").cast("long").alias("n_ratings"), d.alias("disagreement"), (d / F.nullif(F.col("chance"), F.lit(0.0))).alias("vs_chance"))


def _votes(ratings: DataFrame, whole: DataFrame, level: str) -> DataFrame:
    """A row a vote on an item of `whole`: out (its rater), item_id, rating, how many of the item's m votes say the same (c), and the item's sums."""
    x, c, item = F.col("x"), F.col("c"), Window.partitionBy("item_id")
    sums = {"c2": c * c, "s1": c * x, "s2": c * x * x}
    items = positions(whole, level).withColumns({name: F.sum(v).over(item) for name, v in sums.items()})  # a row a value of an item
    return ratings.select("item_id", F.col("rater_id").alias("out"), "rating").join(items, ["item_id", "rating"])


def _shared_sums(whole: DataFrame, level: str, votes: DataFrame) -> DataFrame:
    """By rater left out: o, n_units, n, e, n_values, from the sums over all raters and by how much each of the rater's votes moves them.

    An item without a vote is its counts less one of a value, so a vote needs its item's sums and not the other votes. Only
    of items with two votes does the other go as well, as one rating is none to compare.
    """
    c, m, x = F.col("c"), F.col("m").cast("double"), F.col("x")
    before = spread(level, m, F.col("c2"), F.col("s1"), F.col("s2")) / (m - 1)
    after = spread(level, m - 1, F.col("c2") - 2 * c + 1, F.col("s1") - x, F.col("s2") - x * x) / (m - 2)
    moved = votes.groupBy("out").agg(F.sum(F.when(m > 2, after).otherwise(0.0) - before).alias("d_o"), F.sum(F.when(m > 2, 0).otherwise(-1)).alias("d_units"))
    pairs = votes.where("m = 2").select("out", "item_id", F.col("rating").alias("own")).join(whole.where("m = 2").select("item_id", "rating", "c"), "item_id")
    other = pairs.select("out", "rating", (F.when(F.col("rating") == F.col("own"), 1).otherwise(0) - c).alias("d")).where("d <> 0")
    changed = votes.select("out", "rating", F.lit(-1).cast("long").alias("d")).unionByName(other).groupBy("out", "rating").agg(F.sum("d").cast("double").alias("d"))
    units = unit_stats(whole, level)
    total = units.agg(F.sum("o").alias("o"), F.count("*").alias("n_units"))
    margins = positions(whole, level).groupBy("rating", "x").agg(F.sum("c").cast("double").alias("g"))
    g, d = F.col("g"), F.col("d")
    every = margins.agg(F.sum(g).alias("n"), F.sum(g * g).alias("g2"), F.sum(g * x).alias("s1"), F.sum(g * x * x).alias("s2"), F.count("*").alias("n_values"))
    shift = changed.join(margins, "rating").groupBy("out").agg(F.sum(d).alias("d_n"), F.sum(2 * g * d + d * d).alias("d_g2"), F.sum(d * x).alias("d_s1"), F.sum(d * x * x).alias("d_s2"), F.count_if(g + d == 0).alias("lost"))
    both = moved.join(shift, "out", "full").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(every))  # a row each
    left = lambda c, by: F.col(c) + F.coalesce(F.col(by), F.lit(0))
    n, n_values = left("n", "d_n"), F.col("n_values") - F.coalesce("lost", F.lit(0))
    e = F.when(n_values <= 1, 0.0).otherwise(spread(level, n, left("g2", "d_g2"), left("s1", "d_s1"), left("s2", "d_s2")))
    return both.select("out", left("o", "d_o").alias("o"), left("n_units", "d_units").alias("n_units"), n.alias("n"), e.alias("e"), n_values.alias("n_values"))


#: Values of an ordinal scale up to which tasks are given how often each two of them meet, 8 MB at most.
PAIRED = 1024


def _pair_weights(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, low, high, w): by pair of different values, how often they meet within items, each item's meetings over its ratings less one."""
    a, b = (counts.select(*by, "item_id", F.col("rating").alias(v), F.col("c").alias(f"{v}_c"), *(["m"] if v == "low" else [])) for v in ("low", "high"))
    met = a.join(b, [*by, "item_id"]).where("low < high")
    return met.groupBy(*by, "low", "high").agg(F.sum(2 * F.col("low_c") * F.col("high_c") / (F.col("m") - 1)).alias("w"))


def _ranked_sums(whole: DataFrame, votes: DataFrame) -> DataFrame:
    """As _shared_sums for ordinal ratings: mid-ranks move with each rater left out, so disagreement goes by pairs of values.

    A rater's row changes the counts and meetings of values on the rater's own items; a task adds these to those of all
    items. Beyond PAIRED values the same sums go by joins, rows being raters times values and pairs of values.
    """
    old = votes.select("out", "item_id", F.col("rating").alias("own")).join(whole, "item_id")
    new = old.withColumns({"c": F.col("c") - F.when(F.col("rating") == F.col("own"), 1).otherwise(0), "m": F.col("m") - 1}).where("m >= 2 AND c > 0")
    side = lambda rows, sign: rows.select("out", "rating", (sign * F.col("c")).cast("double").alias("d"))
    changed = side(old, -1).unionByName(side(new, 1)).groupBy("out", "rating").agg(F.sum("d").alias("d"))
    pairs = _pair_weights(old, ["out"]).withColumn("w", -F.col("w")).unionByName(_pair_weights(new, ["out"])).groupBy("out", "low", "high").agg(F.sum("w").alias("w"))
    every = whole.agg(F.count_distinct("item_id").alias("n_units"))
    lost = votes.groupBy("out").agg(F.sum(F.when(F.col("m") == 2, -1).otherwise(0)).alias("k"))
    units = lost.crossJoin(F.broadcast(every)).select("out", (F.col("n_units") + F.col("k")).alias("n_units"))  # a row
    margins = whole.groupBy("rating").agg(F.sum("c").cast("double").alias("g"))
    session = whole.sparkSession
    known = sorted((r.rating, r.g) for r in margins.limit(PAIRED + 1).collect())
    if len(known) <= PAIRED:
        place = {r: k for k, (r, _) in enumerate(known)}
        weights = np.zeros((len(known), len(known)))
        for r in _pair_weights(whole).collect():
            weights[place[r.low], place[r.high]] = r.w
        shared = session.sparkContext.broadcast((place, np.array([g for _, g in known]), weights))
        rows = changed.select("out", F.col("rating").alias("low"), F.lit(None).cast("double").alias("high"), F.col("d").alias("w")).unionByName(pairs.select("out", "low", "high", "w"))
        return units.join(rows.groupBy("out").applyInPandas(_without(shared), rows.select("out").schema.simpleString()[7:-1] + ", o double, n double, e double, n_values long"), "out")
    outs = votes.select("out").distinct()
    counts = outs.crossJoin(margins).select("out", "rating", F.col("g").alias("c")).unionByName(changed.withColumnRenamed("d", "c"))
    counts = counts.groupBy("out", "rating").agg(F.sum("c").alias("c")).where("c > 0").withColumn("m", F.lit(2))
    placed = positions(counts, "ordinal", ["out"]).select("out", "rating", "x")
    pairs = outs.crossJoin(_pair_weights(whole)).unionByName(pairs).groupBy("out", "low", "high").agg(F.sum("w").alias("w"))
    for end in ("low", "high"):
        pairs = pairs.join(placed.select("out", F.col("rating").alias(end), F.col("x").alias(f"{end}_x")), ["out", end])
    gap = F.col("low_x") - F.col("high_x")
    observed = pairs.groupBy("out").agg(F.sum(F.col("w") * gap * gap).alias("o"))
    return units.join(expected(counts, "ordinal", ["out"]), "out").join(observed, "out", "left").select("out", F.coalesce("o", F.lit(0.0)).alias("o"), "n_units", "n", "e", "n_values")


def _without(shared):  # noqa: ANN001, ANN202
    """Of a rater's changes to counts (low, w) and to meetings (low, high, w): the sums without that rater."""

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        place, counts, weights = shared.value
        g, w = counts.copy(), weights.copy()
        low, single = part["low"].map(place).to_numpy(), part["high"].isna().to_numpy()
        g[low[single]] += part["w"].to_numpy()[single]
        w[low[~single], part["high"][~single].map(place).to_numpy(np.int64)] += part["w"].to_numpy()[~single]
        x = np.cumsum(g) - g / 2
        n, e = g.sum(), 2 * (g.sum() * (g * x * x).sum() - (g * x).sum() ** 2)
        left = int((g > 0).sum())
        return pd.DataFrame({"out": part["out"][:1], "o": [float((w * (x[:, None] - x[None]) ** 2).sum())], "n": [n], "e": [e if left > 1 else 0.0], "n_values": [left]})

    return sums


def rater_dropout(ratings: DataFrame, level: str = "nominal") -> DataFrame:
    """Alpha without each rater: rater_id, n_ratings, alpha_without, delta, note. A rater has one rating an item.

    An item's counts without a rater are its counts less that rater's vote, so no two votes are met with each other;
    what the other items add is their sums over all raters.
    """
    ratings = ratings.where(F.col("rating").isNotNull())
    raters = ratings.groupBy("rater_id").agg(F.count("*").alias("n_ratings"))
    n_raters = raters.agg(F.count("*").alias("n_raters"))
    whole = value_counts(ratings)
    votes = _votes(ratings, whole, "nominal" if level == "ordinal" else level)
    sums = _ranked_sums(whole, votes) if level == "ordinal" else _shared_sums(whole, level, votes)
    alpha = F.when(F.col("n_units") >= 2, 1 - (F.col("n") - 1) * F.col("o") / F.nullif(F.col("e"), F.lit(0.0)))
    found = sums.select(F.col("out").alias("rater_id"), alpha.alias("alpha_without"), "n_units", "n_values")
    # a rater none of whose items has another's rating changes nothing
    same = alphas(ratings, level)
    same = same.select(*(F.col(c).alias(f"same_{c}") for c in ("alpha", "n_units", "n_values")))
    rows = raters.join(found, "rater_id", "left").join(F.broadcast(same), F.lit(True), "left").crossJoin(F.broadcast(n_raters)).where("n_raters >= 2")
    kept = lambda c: F.when(F.col("n_units").isNull(), F.col(f"same_{c}")).otherwise(F.col("alpha_without" if c == "alpha" else c))
    note = (
        F.when(F.col("n_raters") == 2, SINGLE_RATER)
        .when(F.coalesce(kept("n_units"), F.lit(0)) == 0, NO_OVERLAP)
        .when(kept("n_values") <= 1, NO_VARIANCE)
        .when(kept("n_units") < 2, ONE_ITEM)
        .otherwise("")
    )
    without = F.when(note == "", kept("alpha"))
    return rows.select("rater_id", "n_ratings", without.alias("alpha_without"), (without - F.col("same_alpha")).alias("delta"), note.alias("note"))


#: Which sums a bootstrap's cells of kind j hold; those of kind 0 hold the counts of value i. Groups follow each other by KINDS.
O, N, S1, S2, KINDS = 1, 2, 3, 4, 8


def alpha_draws(ratings: DataFrame, level: str, n_boot: int, seed: int | None, order: Sequence[str] = ()) -> np.ndarray:
    """Alpha of each resample of the items with two ratings or more, NaN where all its ratings are one value.

    order: columns of ratings that number the items by their first rows, for numpy's stream; items are told apart by
    their ids otherwise.
    """
    counts = value_counts(ratings)
    places = _places(ratings, counts, order) if order else None
    return (_ordinal_draws if level == "ordinal" else _draws_by)(counts, level, n_boot, seed, places)[0]


def alpha_draws_by(ratings: DataFrame, by: str, level: str, n_boot: int, seed: int | None, order: Sequence[str] = (), seeds: Sequence[int] = ()) -> dict[int, np.ndarray]:
    """alpha_draws of each group, numbered from 0, in one pass; with an order, from a seed of each group's own."""
    counts = value_counts(ratings, [by])
    places = _places(ratings, counts, order, by) if order else None
    return (_ordinal_draws if level == "ordinal" else _draws_by)(counts, level, n_boot, list(seeds) if order else seed, places, by)


def _places(ratings: DataFrame, counts: DataFrame, order: Sequence[str], by: str | None = None) -> DataFrame:
    """(g, unit, place) of the items in counts, by their first rows."""
    keys = [by] if by else []
    rows = ratings.where(F.col("rating").isNotNull()).join(counts.select(*keys, "item_id").distinct(), [*keys, "item_id"], "left_semi")
    group = (F.col(by) if by else F.lit(0)).cast("long")
    out = rows.groupBy(group.alias("g"), unit_key(F.col("item_id")).alias("unit")).agg(F.min(F.struct(*order)).alias("place"))
    return out if by else out.drop("g")


def _drawn(cells: DataFrame, places: DataFrame, n_boot: int, seed) -> DataFrame:  # noqa: ANN001
    """cells (g, unit, others) with their multiplicities from numpy's stream, or from one for each group by a list of seeds."""
    return with_draws_by(cells, places, n_boot, seed) if isinstance(seed, list) else with_draws(cells, places, n_boot, seed)


def _draws_by(counts: DataFrame, level: str, n_boot: int, seed, places: DataFrame | None, by: str | None = None) -> dict[int, np.ndarray]:  # noqa: ANN001
    keys, c, x = [by] if by else [], F.col("c"), F.col("rating")
    unit = (unit_number if places is None else unit_key)(F.col("item_id"))
    g = (F.col(by) if by else F.lit(0)).cast("long")
    group = g * KINDS
    stats = unit_stats(counts, level, keys)
    if level == "interval":
        more = counts.groupBy(*keys, "item_id").agg(F.sum(c * x).alias("s1"), F.sum(c * x * x).alias("s2"))
        stats = stats.join(more, [*keys, "item_id"])
        kinds = {O: "o", N: "m", S1: "s1", S2: "s2"}
    else:
        kinds = {O: "o"}
    cells = stats.select(g.alias("g"), unit.alias("unit"), F.inline(F.array(*(F.struct(F.lit(0).cast("long").alias("i"), (group + j).alias("j"), F.col(name).cast("double").alias("x")) for j, name in kinds.items()))))
    if level == "nominal":
        cells = cells.unionByName(counts.select(g.alias("g"), unit.alias("unit"), F.xxhash64("rating").alias("i"), group.alias("j"), c.cast("double").alias("x")))
    cells = cells.drop("g") if places is None else _drawn(cells, places, n_boot, seed).drop("g")
    totals, out = label_totals(cells, n_boot, seed), {}
    of = lambda g, j, k=0: totals[g * KINDS + j][k]
    for g in {j // KINDS for j in totals}:
        o = of(g, O)
        if level == "interval":
            n, s1, s2 = (of(g, j) for j in (N, S1, S2))
            e = 2 * (n * s2 - s1 * s1)
            e = np.where(e <= 1e-12 * n * s2, np.nan, e)
        else:
            n = of(g, 0)
            e = n * n - of(g, 0, 1)
            e = np.where(e == 0, np.nan, e)
        out[g] = 1 - (n - 1) * o / e
    return out


def _disagreement(unit: np.ndarray, place: np.ndarray, c: np.ndarray, m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """By unit of m ratings: the observed disagreement of c ratings at x[place]."""
    at = x[place]
    s1, s2 = (np.bincount(unit, c * p, len(m)) for p in (at, at * at))
    return 2 * (m * s2 - s1 * s1) / (m - 1)


def _mid_ranks(margins: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of counts (resamples, values), each group's values from one of `begins` on: mid-ranks about the middle of the group's ratings; by group the ratings, and the expected disagreement."""
    by_group = lambda x: np.add.reduceat(x, begins, axis=1)
    sizes = np.diff([*begins.tolist(), margins.shape[1]])
    n = by_group(margins)
    before = np.cumsum(n, axis=1) - n
    x = np.cumsum(margins, axis=1) - margins / 2 - np.repeat(before + n / 2, sizes, axis=1)
    e = 2 * (n * by_group(margins * x**2) - by_group(margins * x) ** 2)
    return x, n, np.where(by_group(margins > 0) > 1, e, np.nan)


def _ordinal_draws(counts: DataFrame, level: str, n_boot: int, seed, places: DataFrame | None, by: str | None = None) -> dict[int, np.ndarray]:  # noqa: ANN001
    """In two passes: a resample's counts by value give its mid-ranks, and these the disagreement within its units.

    A group's values are values of its own. Up to WIDE of them, tasks are given the mid-ranks of all; beyond, these stay
    where they are made (see _wide_draws).
    """
    g = (F.col(by) if by else F.lit(0)).cast("long")
    counts = counts.withColumn("g", g)
    values = counts.groupBy("g", "rating").agg(F.lit(1).alias("one")).withColumn("value", F.struct("g", "rating"))
    numbers, width = numbered(values.select("g", "rating", "value", F.lit("").alias("unit")), "value")
    placed = counts.join(numbers.select("g", "rating", F.col("number").alias("i")), ["g", "rating"])
    unit = (unit_number if places is None else unit_key)(F.col("item_id"))
    cells = placed.select("g", "item_id", unit.alias("unit"), "i", F.lit(0).cast("long").alias("j"), F.col("c").cast("double").alias("x"))
    if places is None:
        seed = some_seed(seed)
    else:
        cells, seed = _drawn(cells, places, n_boot, seed), None
    cells = cells.persist()
    try:
        return (_wide_draws if width > WIDE else _narrow_draws)(cells, n_boot, seed)
    finally:
        cells.unpersist()


def _narrow_draws(cells: DataFrame, n_boot: int, seed: int | None) -> dict[int, np.ndarray]:
    first, out, context = 0, [], cells.sparkSession.sparkContext
    drawn = ["times"] if seed is None else []
    groups = dict(cells.groupBy("g").agg(F.min("i")).collect())  # a row a group, WIDE at most
    known, begins = (np.array(x) for x in zip(*sorted(groups.items(), key=lambda r: r[1]), strict=True))
    lists = cells.groupBy("g", "item_id").agg(*(F.first(c).alias(c) for c in ("unit", *drawn)), F.collect_list("i").alias("i"), F.collect_list("x").alias("x"))
    lists = lists.select("g", "unit", *drawn, "i", "x").repartition(4 * context.defaultParallelism, "unit")
    for _, margins in resampled(cells, n_boot, seed) if seed is not None else as_drawn(cells, n_boot):
        x, n, e = _mid_ranks(margins, begins)
        shared = context.broadcast((None if drawn else polynomials(seed, first, first + len(x)), first, x))  # SUMS numbers at most
        sums = {r.g: np.frombuffer(r.o) for r in lists.mapInPandas(_observed(shared), "g long, o binary").groupBy("g").applyInPandas(_group_sum, "g long, o binary").collect()}
        o = np.stack([sums.get(k, np.zeros(len(x))) for k in known.tolist()], axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append(1 - (n - 1) * o / e)
        first += len(x)
    every = np.concatenate(out)
    return {k: every[:, at] for at, k in enumerate(known.tolist())}


def _group_sum(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"g": part["g"][:1], "o": [np.sum([np.frombuffer(o) for o in part["o"]], axis=0).tobytes()]})


def _observed(shared):  # noqa: ANN001, ANN202
    def sums(batches):  # noqa: ANN001, ANN202
        coefficients, first, ranks = shared.value
        total: dict[int, np.ndarray] = {}
        for part in batches:
            if len(part):
                sizes = part["i"].map(len).to_numpy()
                unit, place, c = np.repeat(np.arange(len(part)), sizes), np.concatenate(part["i"].to_list()).astype(np.int64), np.concatenate(part["x"].to_list()).astype(float)
                m, times = np.bincount(unit, c, len(part)), times_of(part, coefficients, first, first + len(ranks))
                own, group = np.unique(part["g"], return_inverse=True)
                found = np.stack([np.bincount(group, times[:, b] * _disagreement(unit, place, c, m, x), len(own)) for b, x in enumerate(ranks)], axis=1)
                for g, o in zip(own.tolist(), found, strict=True):
                    total[g] = total.get(g, 0) + o
        yield pd.DataFrame({"g": list(total), "o": [o.tobytes() for o in total.values()]})

    return sums


def _wide_draws(cells: DataFrame, n_boot: int, seed: int | None) -> dict[int, np.ndarray]:
    """_narrow_draws for any number of values: counts, mid-ranks and disagreements of all resamples by ranges of values.

    Ranks run on from group to group, which leaves distances as they are. The driver holds some rows of n_boot numbers a
    task and group, and tasks are given one for each range.
    """
    coefficients = None if seed is None else polynomials(seed, 0, n_boot)
    ranged = cells.withColumn("j", F.col("g")).repartitionByRange("i", "unit").sortWithinPartitions("i")
    margins = ranged.mapInPandas(_margins(coefficients, n_boot), "g long, i long, sums binary, whole boolean").persist()
    cut: dict[tuple[int, int], np.ndarray] = {}
    for r in margins.where("NOT whole").collect():  # two a task
        cut[r.g, r.i] = cut.get((r.g, r.i), 0) + np.frombuffer(r.sums)
    mended = cells.sparkSession.createDataFrame([(g, i, s.tobytes(), True) for (g, i), s in cut.items()], margins.schema)
    by_value = margins.where("whole").unionByName(mended).select("g", "i", "sums").repartitionByRange("i").withColumn("range_no", F.spark_partition_id()).persist()
    firsts = dict(by_value.groupBy("range_no").agg(F.min("i")).collect())
    rows = by_value.mapInPandas(_range_totals(n_boot), "range_no int, sums binary").collect()  # a row a range
    rows = sorted(rows, key=lambda r: firsts[r.range_no])
    each = np.array([np.frombuffer(r.sums) for r in rows])
    n_all = each.sum(axis=0)
    before = dict(zip((r.range_no for r in rows), np.cumsum(each, axis=0) - each - n_all / 2, strict=True))
    ranks = by_value.sortWithinPartitions("i").mapInPandas(_ranks(before, n_boot), "g long, i long, ranks binary, sums binary").persist()
    sums: dict[int, np.ndarray] = {}
    for r in ranks.where("i IS NULL").select("g", "sums").collect():  # a row a task and group
        sums[r.g] = sums.get(r.g, 0) + np.frombuffer(r.sums).reshape(4, -1)
    met = cells.join(ranks.where("i IS NOT NULL").select("i", "ranks"), "i").repartition("g", "item_id").sortWithinPartitions("g", "item_id")
    observed: dict[int, np.ndarray] = {}
    for r in met.mapInPandas(_item_disagreements(coefficients, n_boot), "g long, o binary").collect():  # a row a task and group
        observed[r.g] = observed.get(r.g, 0) + np.frombuffer(r.o)
    for kept in (margins, by_value, ranks):
        kept.unpersist()
    out = {}
    for g, (n, seen, e1, e2) in sums.items():
        e = np.where(seen > 1, 2 * (n * e2 - e1 * e1), np.nan)
        out[g] = 1 - (n - 1) * observed[g] / e
    return out


def _margins(coefficients: np.ndarray | None, n_boot: int):  # noqa: ANN202
    """Sums by value; those of a task's first and last may be parts."""

    def rows(batches):  # noqa: ANN001, ANN202
        held, begun = None, False
        for (g, i), sums in label_sums(batches, coefficients, n_boot):
            if held is not None:
                yield pd.DataFrame({"g": [held[0]], "i": [held[1]], "sums": [held[2].tobytes()], "whole": [begun]})
                begun = True
            held = g, i, sums
        if held is not None:
            yield pd.DataFrame({"g": [held[0]], "i": [held[1]], "sums": [held[2].tobytes()], "whole": [False]})

    return rows


def _range_totals(n_boot: int):  # noqa: ANN202
    def rows(batches):  # noqa: ANN001, ANN202
        total, own = np.zeros(n_boot), None
        for part in batches:
            for s in part["sums"]:
                total = total + np.frombuffer(s)
            own = int(part["range_no"].iloc[0]) if len(part) else own
        if own is not None:
            yield pd.DataFrame({"range_no": [own], "sums": [total.tobytes()]})

    return rows


def _ranks(before: dict[int, np.ndarray], n_boot: int):  # noqa: ANN202
    """Mid-ranks by value, and last by group: ratings, values that occur, and the sums of counts times ranks and times their squares."""

    def rows(batches):  # noqa: ANN001, ANN202
        upto, sums = None, {}
        for part in batches:
            out = []
            for own, g, s in zip(part["range_no"].tolist(), part["g"].tolist(), part["sums"], strict=True):
                c = np.frombuffer(s)
                upto = before[own] if upto is None else upto
                x = upto + c / 2
                upto = upto + c
                sums[g] = sums.get(g, 0) + np.stack((c, c > 0, c * x, c * x * x))
                out.append(x.tobytes())
            yield pd.DataFrame({"g": part["g"], "i": part["i"], "ranks": out, "sums": None})
        yield pd.DataFrame({"g": list(sums), "i": pd.array([None] * len(sums), "Int64"), "ranks": None, "sums": [x.tobytes() for x in sums.values()]})

    return rows


def _item_disagreements(coefficients: np.ndarray | None, n_boot: int):  # noqa: ANN202
    """Of cells with mid-ranks, sorted by group and item: the disagreements of all items by group, weighed by their multiplicities."""

    def rows(batches):  # noqa: ANN001, ANN202
        total: dict[int, np.ndarray] = {}
        item = times = sums = None

        def ended() -> None:
            if item is not None:
                m, s1, s2 = sums
                total[item[0]] = total.get(item[0], 0) + times * (2 * (m * s2 - s1 * s1) / (m - 1))

        for batch in batches:
            step = max(1, SUMS // max(n_boot, 1) // 4)
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                drawn = times_of(part, coefficients, 0, n_boot)
                for k, (g, own, c, ranks) in enumerate(zip(part["g"].tolist(), part["item_id"].tolist(), part["x"].tolist(), part["ranks"], strict=True)):
                    if (g, own) != item:
                        ended()
                        item, times, sums = (g, own), drawn[k].astype(float), [0.0, 0.0, 0.0]
                    x = np.frombuffer(ranks)
                    sums = [sums[0] + c, sums[1] + c * x, sums[2] + c * x * x]
        ended()
        yield pd.DataFrame({"g": list(total), "o": [o.tobytes() for o in total.values()]})

    return rows


def alpha_interval(ratings: DataFrame, level: str, confidence: float, n_boot: int, seed: int | None, order: Sequence[str] = ()) -> tuple[float, float, int]:
    return usable_interval(alpha_draws(ratings, level, n_boot, seed, order), confidence)


def _number(x: float | None) -> float:
    return NAN if x is None else float(x)


def _sorted_table(df: DataFrame, by: str, ascending: bool) -> pd.DataFrame:
    """On the driver, best known first; undefined last, ties by the first column."""
    table = df.toPandas()
    table = table.sort_values(table.columns[0], kind="stable")
    return table.sort_values(by, ascending=ascending, na_position="last", kind="stable").reset_index(drop=True)


def rater_agreement(ratings: DataFrame, level: str = "nominal", confidence: float = 0.95, bootstrap_ci: bool = True, n_boot: int = 1000, seed: int | None = None, order: Sequence[str] = ()) -> AgreementResult:
    """Krippendorff's alpha with an item bootstrap, and which items and raters it hangs on.

    order: columns that number the rows; the bootstrap then draws from numpy's stream, items in order of their first rows.
    The table of items stays a DataFrame, most disputed first.
    """
    need_confidence(confidence)
    if bootstrap_ci:
        need_resamples(n_boot)
    rows = cleaned(ratings, level, *order).cache()
    try:
        found = alphas(rows, level).first()
        n_items, n_raters = rows.agg(F.count_distinct("item_id"), F.count_distinct("rater_id")).first()
        alpha, overlap = (_number(found.alpha), found.n_units) if found and found.n_units else (NAN, 0)
        low, high, usable = alpha_interval(rows, level, confidence, n_boot, seed, order) if bootstrap_ci and overlap >= 2 else (NAN, NAN, 0)
        raters = _sorted_table(rater_dropout(rows, level), "delta", False)
    finally:
        rows.unpersist()
    items = item_disagreement(rows, level).orderBy(F.desc_nulls_last("disagreement"), "item_id")
    return AgreementResult(alpha, low, high, n_items, n_raters, overlap, level, items, raters, confidence, n_boot if bootstrap_ci else 0, usable, bool(overlap and found.n_values <= 1))


def cohen_stats(pairs: DataFrame, r1: str = "r1", r2: str = "r2") -> DataFrame:
    """n_items, n_categories, p_observed, p_expected, kappa; null is a label like any other."""
    cells = pairs.groupBy(F.col(r1).alias("x"), F.col(r2).alias("y")).agg(F.count("*").alias("c"))
    sides = cells.select(F.col("x").alias("v"), F.col("c").alias("a"), F.lit(0).alias("b")).unionByName(cells.select(F.col("y").alias("v"), F.lit(0).alias("a"), F.col("c").alias("b")))
    margins = sides.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.count("*").alias("n_categories"))
    seen = cells.agg(F.sum("c").alias("n_items"), F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), F.col("c")).otherwise(0)).alias("same"))
    n = F.col("n_items").cast("double")
    both = seen.crossJoin(margins).select("n_items", "n_categories", (F.col("same") / n).alias("p_observed"), (F.col("ab") / (n * n)).alias("p_expected"))
    return both.withColumn("kappa", (F.col("p_observed") - F.col("p_expected")) / F.nullif(1 - F.col("p_expected"), F.lit(0.0)))


def cohens_kappa(pairs: DataFrame, r1: str = "r1", r2: str = "r2") -> KappaResult:
    need_columns(pairs, [r1, r2], "pairs")
    s = cohen_stats(pairs, r1, r2).first()
    if not s.n_items:
        raise ValueError("pairs must not be empty")
    return KappaResult(_number(s.kappa), s.p_observed, s.p_expected, s.n_items, 2, s.n_categories, "cohen")


def fleiss_stats(ratings: DataFrame) -> DataFrame:
    """n_items, least and most ratings an item, n_categories, p_observed, p_expected, kappa."""
    cells = ratings.groupBy("item_id", "rating").agg(F.count("*").alias("c"))
    items = cells.groupBy("item_id").agg(F.sum("c").cast("double").alias("m"), F.sum(F.col("c") * F.col("c")).alias("c2"))
    seen = items.agg(F.count("*").alias("n_items"), F.min("m").cast("long").alias("least"), F.max("m").cast("long").alias("most"), F.avg((F.col("c2") - F.col("m")) / F.nullif(F.col("m") * (F.col("m") - 1), F.lit(0.0))).alias("p_observed"))
    margins = cells.groupBy("rating").agg(F.sum("c").cast("double").alias("g")).agg((F.sum(F.col("g") * F.col("g")) / F.pow(F.sum("g"), F.lit(2))).alias("p_expected"), F.count("*").alias("n_categories"))
    return seen.crossJoin(margins).withColumn("kappa", (F.col("p_observed") - F.col("p_expected")) / F.nullif(1 - F.col("p_expected"), F.lit(0.0)))


def fleiss_kappa(ratings: DataFrame) -> KappaResult:
    rows = cleaned(ratings, "nominal")
    s = fleiss_stats(rows).first()
    if s.least != s.most or s.least < 2:
        raise ValueError(f"Fleiss' kappa needs the same number of ratings, two or more, on every item; here {s.least} to {s.most}. Krippendorff's alpha does without")
    return KappaResult(_number(s.kappa), s.p_observed, s.p_expected, s.n_items, int(s.least), s.n_categories, "fleiss")
