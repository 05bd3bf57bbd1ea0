import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.agreement import NO_OVERLAP, NO_VARIANCE, ONE_ITEM, SINGLE_RATER, alpha_draws, alphas, cohens_kappa, fleiss_kappa, number_of, rater_agreement, rater_dropout
from plumbline.plans import draws

OBSERVERS = [
    [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None],
    [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
    [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None],
    [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None],
]


def frame(spark, columns, kind="double"):
    rows = [(f"u{i}", f"r{k}", None if x is None else (float(x) if kind == "double" else x)) for k, column in enumerate(columns) for i, x in enumerate(column)]
    return spark.createDataFrame(rows, f"item_id string, rater_id string, rating {kind}")


def slow_alpha(columns, level, skip=None):
    units = [[c[i] for k, c in enumerate(columns) if c[i] is not None and k != skip] for i in range(len(columns[0]))]
    units = [u for u in units if len(u) > 1]
    flat = [x for u in units for x in u]
    if len(units) < 2:
        return math.nan
    g = {x: flat.count(x) for x in flat}

    def distance(a, b):
        if level == "nominal":
            return a != b
        if level == "interval":
            return (a - b) ** 2
        low, high = min(a, b), max(a, b)
        return (sum(n for x, n in g.items() if low <= x <= high) - (g[a] + g[b]) / 2) ** 2

    n = len(flat)
    observed = sum(sum(distance(a, b) for a in u for b in u) / (len(u) - 1) for u in units) / n
    expected = sum(distance(a, b) for a in flat for b in flat) / (n * (n - 1))
    return 1 - observed / expected if expected else math.nan


@pytest.mark.parametrize(("level", "alpha"), [("nominal", 0.743421), ("ordinal", 0.815388), ("interval", 0.849107)])
def test_published(spark, level, alpha):
    r = rater_agreement(frame(spark, OBSERVERS), level, n_boot=200, seed=1)
    assert r.alpha == pytest.approx(alpha, abs=1e-6) and r.alpha == pytest.approx(slow_alpha(OBSERVERS, level))
    assert (r.n_items, r.n_raters, r.n_overlapping_items) == (12, 4, 11)
    without = {x.rater_id: x.alpha_without for x in r.rater_dropout.itertuples()}
    for k in range(4):
        assert without[f"r{k}"] == pytest.approx(slow_alpha(OBSERVERS, level, skip=k))
    assert r.ci_low < r.alpha < r.ci_high and "no rater is named" in r.summary()


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
def test_random_ragged(spark, level):
    rng = np.random.default_rng(4)
    for _ in range(3):
        m = rng.integers(1, 6, (4, 20)).astype(object)
        m[rng.random((4, 20)) < 0.25] = None
        assert alphas(frame(spark, m.tolist()), level).first().alpha == pytest.approx(slow_alpha(m.tolist(), level))


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
def test_bootstrap_is_numpys(spark, level):
    rng = np.random.default_rng(1)
    m = rng.integers(1, 4, (3, 12)).tolist()
    rows = [(i, k, float(m[k][i])) for k in range(3) for i in range(12)]
    r = rater_agreement(spark.createDataFrame(rows, "item_id long, rater_id long, rating double"), level, n_boot=60, seed=9, order=["item_id"])
    draws = np.random.default_rng(9).integers(0, 12, size=(60, 12))
    each = np.array([slow_alpha([[c[i] for i in d] for c in m], level) for d in draws])
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.nanpercentile(each, [2.5, 97.5])))


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
def test_keyed_bootstrap_and_order_of_appearance(spark, level):
    """Keyed draws, in blocks or at once, weigh each item as its key says; an order numbers items by their first rows."""
    rng = np.random.default_rng(3)
    rows = [(int(i), k, float(rng.integers(1, 5)), int(rng.integers(10**6))) for i in rng.permutation(25) for k in range(3) if rng.random() < 0.8 or k == 0]
    df = spark.createDataFrame(rows, "item_id long, rater_id long, rating double, at long")
    units = {}
    for i, _, x, _ in rows:
        units.setdefault(i, []).append(x)
    many = {i: u for i, u in units.items() if len(u) > 1}

    def alpha(items):
        flat = [many[i] for i in items]
        wide = [[u[k] if k < len(u) else None for u in flat] for k in range(3)]
        return slow_alpha(wide, level)

    numbers = {r.item_id: r.u for r in df.select("item_id", draws.unit_number(F.col("item_id")).alias("u")).distinct().collect()}
    names = sorted(many)
    want = []
    for c in draws.polynomials(6, 0, 40):
        times = draws.poisson(np.array([numbers[i] for i in names]), np.ones(len(names), np.int64), c)
        want.append(alpha([i for i, n in zip(names, times, strict=True) for _ in range(n)]))
    assert alpha_draws(df, level, 40, 6) == pytest.approx(want)
    first = {i: min(x[3] for x in rows if x[0] == i) for i in many}
    names = sorted(many, key=first.get)
    picks = np.random.default_rng(6).integers(0, len(names), size=(40, len(names)))
    assert alpha_draws(df, level, 40, 6, ["at"]) == pytest.approx([alpha([names[k] for k in p]) for p in picks])


def test_more_than_a_thousand_labels(spark):
    rng = np.random.default_rng(8)
    rows = [(i, k, f"v{i if k else rng.integers(1200)}") for i in range(1200) for k in range(3)]
    df = spark.createDataFrame(rows, "item_id long, rater_id long, rating string")
    table = np.zeros((1200, 1200))
    for i, _, x in rows:
        table[i, int(x[1:])] += 1
    picks = np.random.default_rng(2).integers(0, 1200, size=(25, 1200))
    g = np.array([np.bincount(p, minlength=1200) for p in picks])
    o, margins = g @ ((9 - (table**2).sum(axis=1)) / 2), g @ table
    n = margins.sum(axis=1)
    assert alpha_draws(df, "nominal", 25, 2, ["item_id"]) == pytest.approx(1 - (n - 1) * o / (n * n - (margins**2).sum(axis=1)))


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
def test_dropout_of_sparse_ratings(spark, level):
    rng = np.random.default_rng(5)
    m = rng.integers(1, 5, (6, 30)).astype(object)
    m[rng.random((6, 30)) < 0.6] = None
    got = {r.rater_id: r for r in rater_dropout(frame(spark, m.tolist()), level).collect()}
    for k in range(6):
        assert got[f"r{k}"].alpha_without == pytest.approx(slow_alpha(m.tolist(), level, skip=k))


def test_labels_missing_and_refusals(spark):
    r = rater_agreement(frame(spark, [["a", "b", "a"], ["a", "b", None], ["b", "b", "a"]], "string"), bootstrap_ci=False)
    assert r.n_overlapping_items == 3 and "No interval was asked for" in r.summary()
    same = rater_agreement(frame(spark, [["1", "2"], ["1.0", "2.0"]], "string"), n_boot=50, seed=1)
    assert same.alpha == 1
    for bad, says in (([["a", "b"], ["a", "c"]], "numeric"),):
        with pytest.raises(ValueError, match=says):
            rater_agreement(frame(spark, bad, "string"), "ordinal")
    twice = frame(spark, [[1, 2]]).union(frame(spark, [[1, 2]]))
    with pytest.raises(ValueError, match="twice"):
        rater_agreement(twice)
    with pytest.raises(ValueError, match="empty"):
        rater_agreement(frame(spark, [[None]]))


def test_undefined_cases(spark):
    none = rater_agreement(frame(spark, [[1, None], [None, 2]]))
    assert math.isnan(none.alpha) and none.n_overlapping_items == 0 and "cannot be measured" in none.summary()
    flat = rater_agreement(frame(spark, [[1, 1], [1, 1]]), n_boot=20)
    assert math.isnan(flat.alpha) and "one value" in flat.summary()
    one = rater_agreement(frame(spark, [[1, 2], [2, None]]), n_boot=20)
    assert math.isnan(one.alpha) and "one item" in one.summary()


def test_dropout_notes(spark):
    notes = lambda m: {r.rater_id: r.note for r in rater_dropout(frame(spark, m)).collect()}
    assert set(notes([[1, 2], [1, 1]]).values()) == {SINGLE_RATER}
    assert notes([[1, 2, 1], [1, 2, 2], [None, None, 1]])["r0"] == ONE_ITEM
    assert notes([[1, 2], [1, 1], [1, 1]])["r0"] == NO_VARIANCE
    assert notes([[1, 2, None], [1, None, None], [None, 2, None]])["r0"] == NO_OVERLAP
    assert notes([[1, 2]]) == {}


def test_kappas(spark):
    x, y = [0] * 20 + [1] * 20, [0] * 15 + [1] * 5 + [1] * 17 + [0] * 3
    r = cohens_kappa(spark.createDataFrame(list(zip(x, y, strict=True)), "r1 int, r2 int"))
    p = np.mean(np.array(x) == np.array(y))
    e = 0.5 * (18 / 40) + 0.5 * (22 / 40)
    assert r.kappa == pytest.approx((p - e) / (1 - e)) and r.n_categories == 2
    assert math.isnan(cohens_kappa(spark.createDataFrame([(1, 1)], "r1 int, r2 int")).kappa)
    m = [[1, 1, 2], [1, 2, 2], [1, 2, 2]]
    f = fleiss_kappa(frame(spark, m))
    pe = (4 / 9) ** 2 + (5 / 9) ** 2
    assert f.kappa == pytest.approx(((1 + 1 / 3 + 1) / 3 - pe) / (1 - pe)) and f.n_raters == 3
    with pytest.raises(ValueError, match="same number"):
        fleiss_kappa(frame(spark, OBSERVERS))


def test_labels_that_spell_numbers(spark):
    told = {"1_000.5": 1000.5, " 2 ": 2.0, "-.5e1": -5.0, "1d": None, "1f": None, "0x1": None, "1__0": None, "_1": None, "": None, "inf": math.inf, "a": None}
    got = {r.x: r.y for r in spark.createDataFrame([(k,) for k in told], "x string").withColumn("y", number_of(F.col("x"))).collect()}
    assert got == told


def test_tables_of_a_result(spark):
    r = rater_agreement(frame(spark, OBSERVERS), n_boot=20, seed=1)
    tables = r.tables(spark)
    assert set(tables) == {"item_disagreement", "rater_dropout"} and tables["rater_dropout"].count() == 4 and tables["item_disagreement"].count() == 11
