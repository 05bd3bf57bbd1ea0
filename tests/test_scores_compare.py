import itertools
import math

import numpy as np
import pytest

from plumbline.operators.compare import compare_independent, compare_paired, mcnemar_p, null_ranks, paired, signed_trim
from plumbline.operators.scores import score_ci
from plumbline.plans import draws, walsh


def column(spark, values, name="score"):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(values)], f"item_id long, {name} double")


def pairs(spark, a, b):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "item_id long, a double, b double")


def test_score_methods(spark):
    r = score_ci(column(spark, [1] * 42 + [0] * 8))
    assert (r.method, r.binary, r.n) == ("wilson", True, 50) and (r.ci_low, r.ci_high) == pytest.approx((0.714858, 0.916626), abs=1e-6)
    x = np.random.default_rng(1).normal(3, 1, 40)
    r = score_ci(column(spark, x), method="t")
    half = 2.0226909 * x.std(ddof=1) / math.sqrt(40)
    assert (r.ci_low, r.ci_high) == pytest.approx((x.mean() - half, x.mean() + half), abs=1e-6)
    r = score_ci(column(spark, x), n_boot=500, seed=3, order=["item_id"])
    means = x[np.random.default_rng(3).integers(0, 40, size=(500, 40))].mean(axis=1)
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    assert "weak" in score_ci(column(spark, [1, 0, 1])).summary()


@pytest.mark.parametrize(("values", "method", "says"), [([], "auto", "empty"), ([1.0, None], "auto", "first item 1"), ([float("inf")], "auto", "finite"), ([0.5], "wilson", "0/1"), ([1, 0], "t", "0/1"), ([0.5], "t", "one score"), ([0.5, 0.5], "t", "equal"), ([1], "no", "method")])
def test_score_refusals(spark, values, method, says):
    with pytest.raises(ValueError, match=says):
        score_ci(column(spark, values), method=method)


def test_keyed_bootstrap(spark):
    x = np.random.default_rng(2).normal(0, 1, 400)
    frame = column(spark, x)
    a = score_ci(frame, n_boot=400, seed=1)
    b = score_ci(frame.repartition(7), n_boot=400, seed=1)
    assert (a.ci_low, a.ci_high) == pytest.approx((b.ci_low, b.ci_high))
    assert a.width == pytest.approx(2 * 1.96 * x.std() / 20, rel=0.15)
    equal = score_ci(column(spark, [1] * 300 + [0] * 700), method="bootstrap", n_boot=400, seed=2)
    assert equal.width == pytest.approx(2 * 1.96 * (0.3 * 0.7 / 1000) ** 0.5, rel=0.6) and equal.ci_low < 0.3 < equal.ci_high


def test_poisson_of_many():
    units = np.random.default_rng(1).integers(0, 2**60, 4000)
    polynomial = draws.polynomials(5, 1, 2)[0]
    for mean in (1, 3, 50, 900, 10**6):
        got = draws.poisson(units, np.full(4000, mean), polynomial)
        assert got.mean() == pytest.approx(mean, rel=0.06) and got.var() == pytest.approx(mean, rel=0.12)


def test_resamples_are_like_independent_draws():
    """Moments of a resampled sum over many resamples, and of two units' multiplicities in one."""
    units = np.random.default_rng(2).integers(0, 2**60, 200)
    times = np.array([draws.poisson(units, np.ones(200, np.int64), c) for c in draws.polynomials(9, 0, 4000)])
    x = np.random.default_rng(3).exponential(1, 200)
    sums = times @ x
    z = (sums - x.sum()) / np.sqrt((x**2).sum())
    assert abs(z.mean()) < 0.06 and z.std() == pytest.approx(1, abs=0.05)
    assert (z**3).mean() == pytest.approx((x**3).sum() / (x**2).sum() ** 1.5, abs=0.15) and (z**4).mean() == pytest.approx(3, abs=0.35)
    assert np.abs(np.corrcoef(times[:, :50].T) - np.eye(50)).max() < 0.08 and np.abs(np.corrcoef(times[:50]) - np.eye(50)).max() < 0.35


def test_the_scheme_does_not_depend_on_size(spark, monkeypatch):
    """Sums in blocks of resamples or at once, dense or not, are the same."""
    frame = column(spark, np.random.default_rng(5).normal(0, 1, 300))
    want = score_ci(frame, n_boot=90, seed=4)
    monkeypatch.setattr(draws, "SUMS", 40)
    got = score_ci(frame, n_boot=90, seed=4)
    assert (got.ci_low, got.ci_high) == pytest.approx((want.ci_low, want.ci_high), rel=1e-12)


def test_mcnemar(spark):
    assert mcnemar_p(17, 7) == pytest.approx(0.06391465663909912)
    assert mcnemar_p(18, 7) == pytest.approx(0.0455002638963584)
    assert mcnemar_p(0, 0) == 1
    a = [1] * 18 + [0] * 7 + [1] * 75
    b = [0] * 18 + [1] * 7 + [1] * 75
    r = compare_paired(pairs(spark, a, b))
    assert (r.method, r.n_discordant, r.difference) == ("mcnemar", 25, pytest.approx(0.11)) and not r.crosses_zero
    same = compare_paired(pairs(spark, [1] * 9, [1] * 9))
    assert same.crosses_zero and same.ci_low < 0 < same.ci_high and "not proof" in same.summary()


def test_signed_rank_trims():
    known = {6: 0, 7: 2, 8: 3, 9: 5, 10: 8, 11: 10, 12: 13, 13: 17, 14: 21, 15: 25, 16: 29, 17: 34, 18: 40, 20: 52, 25: 89}
    assert {n: signed_trim(n, 0.95, True) for n in known} == known
    assert null_ranks(3) == [1, 1, 1, 2, 1, 1, 1]


def test_wilcoxon_against_all_sign_patterns(spark):
    x = np.array([1.1, -0.3, 2.7, 0.9, 3.3, -1.7, 4.1, 5.2])
    r = compare_paired(pairs(spark, x, np.zeros(8)), method="wilcoxon")
    ranks = np.abs(x).argsort().argsort() + 1
    w = min(ranks[x > 0].sum(), ranks[x < 0].sum())
    sums = [sum(s) for s in itertools.product(*((0, k) for k in range(1, 9)))]
    assert r.p_value == pytest.approx(min(1, 2 * np.mean(np.array(sums) <= w)))
    averages = np.sort([(x[i] + x[j]) / 2 for i in range(8) for j in range(i, 8)])
    assert r.difference == pytest.approx(np.median(averages)) and (r.ci_low, r.ci_high) == pytest.approx((averages[3], averages[-4]))
    with pytest.raises(ValueError, match="too few"):
        compare_paired(pairs(spark, [1, 2, 1, 2], [0, 0, 0, 0]), method="wilcoxon")
    assert compare_paired(pairs(spark, [1, 2], [1, 2]), method="wilcoxon").p_value == 1


@pytest.mark.parametrize("real", [False, True])
def test_walsh_ranks_without_the_list(real):
    r = np.random.default_rng(3)
    x = np.sort(r.normal(0, 1, 25) if real else r.choice(np.arange(-40, 40), 25, replace=False).astype(float))
    c = r.integers(1, 4, 25)
    each = np.repeat(x, c)
    listed = np.sort([(each[i] + each[j]) / 2 for i in range(len(each)) for j in range(i, len(each))])
    assert [walsh.average_at(x, c, k) for k in range(len(listed))] == listed.tolist()


@pytest.mark.parametrize("kind", ["real", "cents", "spike"])
def test_walsh_ranks_by_ranges(spark, monkeypatch, kind):
    r = np.random.default_rng(4)
    x = {"real": r.normal(0.1, 1, 400), "cents": r.integers(-90, 90, 400) / 100, "spike": np.concatenate((r.normal(0, 1e-9, 200), r.normal(0, 1e6, 200)))}[kind]
    x, c = np.unique(x, return_counts=True)
    c = c * r.integers(1, 4, len(c))
    each = np.repeat(x, c)
    i, j = np.triu_indices(len(each))
    listed = np.sort((each[i] + each[j]) / 2)
    values = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, c, strict=True)], "d double, n long")
    places = [0, len(listed) // 40, (len(listed) - 1) // 2, len(listed) // 2, len(listed) - 1]
    monkeypatch.setattr(walsh, "RANGE", 25)
    assert walsh.averages_at(values, len(x), places) == listed[places].tolist()


def test_inner_products_past_64_bits():
    a, b = np.array([3 << 40, 5, 7 << 41], np.int64), np.array([1 << 41, 9, (1 << 40) + 1], np.int64)
    assert walsh.dot(a, b) == sum(int(x) * int(y) for x, y in zip(a, b, strict=True))


def test_independent(spark):
    r = compare_independent(column(spark, [1] * 40 + [0] * 20), column(spark, [1] * 30 + [0] * 50))
    p = 70 / 140
    z = (40 / 60 - 30 / 80) / math.sqrt(p * (1 - p) * (1 / 60 + 1 / 80))
    assert r.method == "score" and r.p_value == pytest.approx(math.erfc(z / math.sqrt(2))) and r.ci_low > 0
    g = np.random.default_rng(4)
    x, y = g.normal(0, 0.05, 12), g.normal(0.1, 0.3, 70)
    r = compare_independent(column(spark, x), column(spark, y), method="t")
    e1, e2 = x.var(ddof=1) / 12, y.var(ddof=1) / 70
    df = (e1 + e2) ** 2 / (e1**2 / 11 + e2**2 / 69)
    from plumbline.functions.special import t_quantile

    assert r.ci_high - r.difference == pytest.approx(t_quantile(0.975, df) * math.sqrt(e1 + e2))
    r = compare_independent(column(spark, x), column(spark, y), n_boot=300, seed=5, order=["item_id"])
    rng = np.random.default_rng(5)
    boot = x[rng.integers(0, 12, size=(300, 12))].mean(axis=1) - y[rng.integers(0, 70, size=(300, 70))].mean(axis=1)
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.percentile(boot, [2.5, 97.5])))


def test_pairing_refuses_lone_items(spark):
    with pytest.raises(ValueError, match="one side"):
        paired(column(spark, [1, 2, 3]), column(spark, [1, 2]))
    assert paired(column(spark, [1, 2]), column(spark, [3, 4])).count() == 2


@pytest.mark.parametrize(("query", "operator"), [("q_compare_paired", "compare_paired"), ("q_compare_independent", "compare_independent")])
def test_comparisons_make_their_view_once(spark, monkeypatch, query, operator):
    from plumbline.plans import queries

    plans, compare = [], getattr(queries.cmp, operator)

    def watched(*args, **more):
        plans.append(args[0]._jdf.queryExecution().withCachedData().toString())
        return compare(*args, **more)

    monkeypatch.setattr(queries.cmp, operator, watched)
    queries.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and all("InMemoryRelation" in p for p in plans)
