import math

import pytest

from plumbline.functions import intervals, special


def test_published_quantiles_and_tails():
    assert special.t_quantile(0.975, 1) == pytest.approx(math.tan(math.pi * 0.475), rel=1e-10)
    assert special.t_quantile(0.975, 2) == pytest.approx(4.302652729911275, rel=1e-10)
    assert special.t_quantile(0.025, 10) == pytest.approx(-2.2281388519649385, rel=1e-9)
    assert special.t_quantile(0.975, 1e9) == pytest.approx(1.959963984540054, rel=1e-6)
    assert special.chi2_one_sf(3.841458820694124) == pytest.approx(0.05, rel=1e-12)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)


@pytest.mark.parametrize(("a", "b"), [(1, 1), (0.5, 0.5), (3, 7), (500, 500), (20000, 3)])
def test_beta_quantile_inverts(a, b):
    for p in (0.025, 0.3, 0.5, 0.975):
        assert special.beta_cdf(special.beta_quantile(p, a, b), a, b) == pytest.approx(p, abs=1e-9)


def test_binomial():
    assert special.binomial_half_two_sided(3, 14) == pytest.approx(0.057373046875)
    assert special.binomial_half_cdf(1200, 2500) == pytest.approx(0.0239, abs=2e-3)
    assert math.isnan(special.binomial_half_two_sided(0, 0))


@pytest.mark.parametrize(("k", "n", "low", "high"), [(42, 50, 0.714858, 0.916626), (9, 10, 0.595850, 0.982124), (0, 20, 0, 0.161125), (20, 20, 0.838875, 1), (58, 100, 0.482065, 0.672016)])
def test_wilson(k, n, low, high):
    assert intervals.wilson(k, n, 0.95) == pytest.approx((low, high), abs=1e-6)


def test_clopper_pearson_inverts_its_test():
    for n in range(1, 40):
        for k in range(n + 1):
            low, high = intervals.clopper_pearson(k, n, 0.95)
            outside = low > 0.5 or high < 0.5
            assert outside == (special.binomial_half_two_sided(k, n) < 0.05)


def test_score_intervals_agree_with_their_tests():
    z = special.z_of(0.95)
    for n in (10, 40):
        for b in range(0, n // 2, 2):
            for c in range(0, n // 2, 3):
                low, high = intervals.paired_difference(b, c, n, 0.95)
                assert low <= (b - c) / n <= high
                if b + c:
                    assert (low > 0 or high < 0) == (abs(b - c) / math.sqrt(b + c) > z)
                if -1 < low:
                    assert intervals.paired_score(b, c, n, low) == pytest.approx(z, abs=1e-6)
    for k1 in range(0, 21, 4):
        for k2 in range(0, 31, 6):
            low, high = intervals.independent_difference(k1, 20, k2, 30, 0.95)
            p = (k1 + k2) / 50
            se = math.sqrt(p * (1 - p) * (1 / 20 + 1 / 30))
            assert low <= k1 / 20 - k2 / 30 <= high
            if se:
                assert (low > 0 or high < 0) == (abs(k1 / 20 - k2 / 30) / se > z)
