import math

import numpy as np
import pytest

from plumbline.operators import agreement as ag
from plumbline.operators.judge import _baseline, judge_validation
from plumbline.operators.length import NO_LENGTH, ONE_OUTCOME, SEPARATED, length_bias
from plumbline.operators.position import couples, position_bias
from tests.test_agreement import slow_alpha


def labels(spark, human, judge, slices=None):
    rows = [(i, h, j, None if slices is None else slices[i]) for i, (h, j) in enumerate(zip(human, judge, strict=True))]
    return spark.createDataFrame(rows, "item_id long, human string, judge string, slice string")


def test_overall_and_slices(spark):
    r = np.random.default_rng(1)
    human = r.choice(["a", "b"], 200).tolist()
    slices = ["hard" if i < 60 else "easy" for i in range(200)]
    judge = [h if slices[i] == "easy" or r.random() < 0.3 else "ab".replace(h, "") for i, h in enumerate(human)]
    human[3], judge[7] = None, None
    v = judge_validation(labels(spark, human, judge, slices), n_boot=100, seed=1)
    kept = [i for i in range(200) if i not in (3, 7)]
    assert (v.n_items, v.n_dropped) == (198, 2)
    assert v.accuracy == pytest.approx(np.mean([human[i] == judge[i] for i in kept]))
    assert v.agreement == pytest.approx(slow_alpha([[human[i] for i in kept], [judge[i] for i in kept]], "nominal"))
    assert v.by_slice["slice"].tolist() == ["hard", "easy"] and v.distinguishable_slice == "hard" and "hard" in v.summary()


def test_baseline(spark):
    r = np.random.default_rng(2)
    truth = r.choice(["a", "b"], 90)
    flip = lambda x, p: "ab".replace(x, "") if r.random() < p else x
    judge = [flip(t, 0.1) for t in truth]
    judge[0], judge[1] = None, " TIE"
    rows = [(i, i % 30, k, flip(t, 0.2)) for i, t in enumerate(truth) for k in range(3)]
    rows = [x for x in rows if x[0] != 2 or x[2] == 0] + [(3, 3, 9, "Tie ")]
    base = spark.createDataFrame(rows, "item_id long, cluster_id long, rater_id long, rating string")
    v = judge_validation(labels(spark, truth.tolist(), judge), human_baseline=base, ties="drop", n_boot=100, seed=1)
    assert (v.baseline_n_no_judge_label, v.baseline_n_too_few_humans, v.baseline_n_judge_ties, v.baseline_n_items) == (1, 1, 1, 87)
    kept = [i for i in range(90) if i > 2]
    votes = {i: [x[3] for x in rows if x[0] == i and x[3] != "Tie "] for i in kept}
    hh = [[votes[i][k] for i in kept] for k in range(3)]
    jh = [[v for i in kept for v in votes[i]], [judge[i] for i in kept for _ in votes[i]]]
    assert v.baseline_human_human == pytest.approx(slow_alpha(hh, "nominal")) and v.baseline_judge_human == pytest.approx(slow_alpha(jh, "nominal"))
    assert v.baseline_ci_low < v.baseline_difference < v.baseline_ci_high and "Over 87 items" in v.summary()
    with pytest.raises(ValueError, match="ties"):
        judge_validation(labels(spark, ["a"], ["a"]), human_baseline=base)
    with pytest.raises(ValueError, match="not among"):
        judge_validation(labels(spark, ["a"], ["a"]), human_baseline=base, ties="category")


@pytest.mark.parametrize("n_values", [40, 1200])
def test_baseline_draws_are_numpys_whatever_the_number_of_values(spark, n_values):
    """Clusters are numbered by their first rows, and the counts of all values enter."""
    r = np.random.default_rng(4)
    truth = r.integers(0, n_values, 400)
    judge = [f"v{t if r.random() < 0.8 else r.integers(n_values)}" for t in truth]
    place = r.permutation(1200).tolist()
    rows = [(i, i % 20, k, f"v{t if r.random() < 0.7 else r.integers(n_values)}", place.pop()) for i, t in enumerate(truth) for k in range(3)]
    base = spark.createDataFrame(rows, "item_id long, cluster_id long, rater_id long, rating string, at long")
    told = labels(spark, judge, judge)
    got = _baseline(base, told, "category", 0.95, 60, 3, ["at"])
    clusters = sorted(range(20), key=lambda c: min(x[4] for x in rows if x[1] == c))
    values = {v: k for k, v in enumerate(sorted({x[3] for x in rows} | set(judge)))}
    o, h, j = np.zeros((20, 2)), np.zeros((20, len(values))), np.zeros((20, len(values)))
    for i, c, _, v, _ in rows:
        at = clusters.index(c)
        o[at, 1] += 2 * (v != judge[i])
        h[at, values[v]] += 1
        j[at, values[v]] += 1
        j[at, values[judge[i]]] += 1
    for i in range(400):
        own = [x[3] for x in rows[3 * i : 3 * i + 3]]
        o[clusters.index(i % 20), 0] += sum(x != y for x in own for y in own) / 2
    picks = np.random.default_rng(3).integers(0, 20, size=(60, 20))
    times = np.array([np.bincount(p, minlength=20) for p in picks])
    alpha = lambda d, c: 1 - (c.sum(1) - 1) * d / (c.sum(1) ** 2 - (c**2).sum(1))
    want = np.percentile(alpha(times @ o[:, 1], times @ j) - alpha(times @ o[:, 0], times @ h), [2.5, 97.5])
    assert (got["baseline_ci_low"], got["baseline_ci_high"]) == pytest.approx(want.tolist()) and got["baseline_n_boot_usable"] == 60
    keyed = _baseline(base, told, "category", 0.95, 300, 3)
    assert keyed["baseline_ci_low"] == pytest.approx(want[0], abs=0.03) and keyed["baseline_ci_high"] == pytest.approx(want[1], abs=0.03)


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
def test_slices_by_first_appearance_with_their_own_seeds(spark, level):
    r = np.random.default_rng(6)
    human = [str(x) for x in r.integers(1, 4, 90)]
    judge = [h if r.random() < 0.6 else str(r.integers(1, 4)) for h in human]
    slices = [["c", "a", "b"][0 if i == 0 else r.integers(3)] for i in range(90)]
    v = judge_validation(labels(spark, human, judge, slices), level, n_boot=50, seed=7, order=["item_id"])
    rng, want = np.random.default_rng(7), {}
    for name in dict.fromkeys(slices):
        mine = [i for i in range(90) if slices[i] == name]
        picks = np.random.default_rng(int(rng.integers(2**32))).integers(0, len(mine), size=(50, len(mine)))
        each = [slow_alpha([[float(side[mine[k]]) for k in p] for side in (human, judge)], level) for p in picks]
        want[name] = np.nanpercentile(each, [2.5, 97.5])
    assert set(want) == set(v.by_slice["slice"])
    for x in v.by_slice.itertuples():
        assert (x.ci_low, x.ci_high) == pytest.approx(want[x.slice].tolist())
    whole = np.random.default_rng(7).integers(0, 90, size=(50, 90))
    each = [slow_alpha([[float(side[k]) for k in p] for side in (human, judge)], level) for p in whole]
    assert (v.ci_low, v.ci_high) == pytest.approx(np.nanpercentile(each, [2.5, 97.5]).tolist())
    keyed = judge_validation(labels(spark, human, judge, slices), level, n_boot=200, seed=7)
    assert keyed.ci_low == pytest.approx(v.ci_low, abs=0.12) and keyed.by_slice["ci_low"].notna().all()


def test_labels_without_ids(spark):
    rows = labels(spark, ["a", "b"] * 20, ["a", "b", "b", "b"] * 10).drop("item_id")
    v = judge_validation(rows, n_boot=50, seed=1)
    assert v.n_items == 40 and v.ci_low < v.agreement < v.ci_high


def shown(spark, rows):
    return spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "seq long, pair_id long, option_a string, option_b string, winner string")


def test_randomised(spark):
    rows = [(i, "x", "y", "x" if i < 70 else "y") for i in range(100)] + [(200, "x", "y", None)]
    r = position_bias(shown(spark, rows), order="seq")
    assert (r.design, r.n_a_wins, r.n_decisive, r.n_ties) == ("randomised", 70, 100, 1) and r.has_effect
    r = position_bias(shown(spark, [(i, "x", "y", "x" if i < 11 else "y") for i in range(14)]), order="seq")
    assert r.p_value == pytest.approx(0.057373046875) and not r.has_effect and "cannot show" in r.summary()


def slow_couple(rows):
    seen = []
    for a, b, w in rows:
        if w is None:
            continue
        for x, y, v in seen:
            if (x, y) == (b, a):
                return v == w, v == x and w == a
        seen.append((a, b, w))
    return None


def test_couples_match_the_row_loop(spark):
    r = np.random.default_rng(3)
    rows = []
    for p in range(150):
        for _ in range(r.integers(1, 8)):
            a, b = r.choice(["x", "y", "z"], 2, replace=False).tolist()
            rows.append((p, a, b, r.choice([a, b, None])))
    got = {x.pair_id: (x.consistent, x.to_first) for x in couples(shown(spark, rows)).collect()}
    want = {p: slow_couple([x[1:] for x in rows if x[0] == p]) for p in range(150)}
    assert got == {p: c for p, c in want.items() if c}


def test_both_orders_and_refusals(spark):
    rows = [x for p in range(20) for x in ((p, "x", "y", "x"), (p, "y", "x", "y" if p < 12 else "x"))]
    r = position_bias(shown(spark, rows), order="seq")
    assert (r.design, r.n_pairs_scored, r.consistency_rate, r.n_decisive, r.n_a_wins) == ("both_orders", 20, 0.4, 12, 12) and r.has_effect
    for bad in ([], [(1, "x", "x", "x")], [(1, "x", "y", "z")], [(None, "x", "y", "x")]):
        with pytest.raises(ValueError):
            position_bias(shown(spark, bad), order="seq")


def lengths(spark, rows):
    return spark.createDataFrame(rows, "preference string, len_a long, len_b long, human_preference string")


def slow_logistic(x, y):
    b = np.zeros(2)
    d = np.column_stack((np.ones(len(x)), x))
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ b))
        b = b + np.linalg.solve((d.T * (p * (1 - p))) @ d, d.T @ (y - p))
    return b[1], math.sqrt(np.linalg.inv((d.T * (p * (1 - p))) @ d)[1, 1])


def test_length_fits(spark):
    r = np.random.default_rng(5)
    la, lb = r.integers(50, 400, 300), r.integers(50, 400, 300)
    first = r.random(300) < 1 / (1 + np.exp(-(la - lb) / 120))
    human = r.random(300) < 0.5
    rows = [(" a" if f else "B", int(a), int(b), "1" if h else "0") for f, a, b, h in zip(first, la, lb, human, strict=True)]
    v = length_bias(lengths(spark, rows))
    slope, se = slow_logistic((la - lb).astype(float), first.astype(float))
    assert v.coefficient == pytest.approx(slope, rel=1e-6) and v.ci_high - v.coefficient == pytest.approx(1.959963984540054 * se, rel=1e-6)
    x2 = np.where(human, lb - la, la - lb).astype(float)
    slope, _ = slow_logistic(x2, (first != human).astype(float))
    assert v.disagreement_coefficient == pytest.approx(slope, rel=1e-6) and v.n_disagreements == (first != human).sum()
    assert v.longer_rate == pytest.approx(np.mean(np.where(first, la > lb, lb > la))) and "longer options win" in v.summary()


@pytest.mark.parametrize(("rows", "note"), [([("1", 5, 3, "1"), ("1", 2, 9, "1")], ONE_OUTCOME), ([("1", 5, 3, "1"), ("0", 5, 3, "1")], NO_LENGTH), ([("1", 9, 3, "1"), ("0", 1, 8, "1"), ("1", 7, 1, "0")], SEPARATED)])
def test_length_refusals(spark, rows, note):
    v = length_bias(lengths(spark, rows))
    assert math.isnan(v.coefficient) and v.note == note and note in v.summary()


def test_length_bad_choice(spark):
    with pytest.raises(ValueError, match="neither"):
        length_bias(lengths(spark, [("2", 1, 2, "1")]))


def test_baseline_is_refused_before_anything_is_drawn(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(ag, "alpha_interval", lambda *_: drawn.append(1) or (0.0, 0.0, 0))
    base = spark.createDataFrame([(0, c, f"r{c}", "a") for c in (1, 2)], "item_id long, cluster_id long, rater_id string, rating string")
    with pytest.raises(ValueError, match="item_id=0 has 2 different values of cluster_id"):
        judge_validation(labels(spark, ["a", "b"], ["a", "b"]), human_baseline=base, ties="category")
    assert not drawn
