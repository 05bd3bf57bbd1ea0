import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import pairwise as pw
from plumbline.operators.pairwise import bradley_terry, ratings_of, reachable, to_elo
from plumbline.plans import boards


def random_board(rng, n, most=4):
    credit = rng.integers(0, most, (n, n)).astype(float)
    credit[np.arange(n), np.arange(n)] = 0
    return credit


def test_sparse_fit_is_the_dense_one():
    rng = np.random.default_rng(1)
    done = 0
    while done < 20:
        credit = random_board(rng, int(rng.integers(2, 12)), 3) * rng.choice([0.5, 1, 40])
        if not reachable(credit > 0).all():
            continue
        done += 1
        i, j = np.nonzero(credit)
        assert boards.one_strong_part(len(credit), i, j)
        twice = np.concatenate((i, i)), np.concatenate((j, j)), np.concatenate((credit[i, j] / 4, 3 * credit[i, j] / 4))
        for parts in ((i, j, credit[i, j]), twice):
            assert np.abs(boards.fitted(len(credit), *parts) - ratings_of(credit)).max() < 1e-9


def test_parts_match_matrices():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        beat = rng.random((n, n)) < 0.15
        beat[np.arange(n), np.arange(n)] = False
        i, j = np.nonzero(beat)
        both, way = reachable(beat | beat.T), reachable(beat)
        assert boards.parts(n, i, j).tolist() == [int(np.flatnonzero(row).min()) for row in both]
        assert boards.strong_parts(n, i, j).tolist() == [int(np.flatnonzero(row).min()) for row in way & way.T]
        assert boards.one_strong_part(n, i, j) == way.all()


def test_a_long_chain_and_two_islands():
    n = 50_000
    order = np.random.default_rng(3).permutation(n)
    a, b = order[:-1], order[1:]
    assert (boards.parts(n, a, b) == 0).all()
    first, last = boards.ends(n, a, b)
    assert first.tolist() == [order[0]] and last.tolist() == [order[-1]]
    cut = np.arange(n - 1) != 20_000
    assert len(set(boards.parts(n, a[cut], b[cut]).tolist())) == 2
    ring = np.append(a, order[-1]), np.append(b, order[0])
    assert (boards.strong_parts(n, *ring) == 0).all() and boards.one_strong_part(n, *ring)


def games(spark, n_models, n, seed=4):
    rng = np.random.default_rng(seed)
    strength = rng.normal(0, 0.7, n_models)
    a, b = rng.integers(0, n_models, (2, n))
    b = np.where(a == b, (b + 1) % n_models, b)
    won = rng.random(n) < 1 / (1 + np.exp(strength[b] - strength[a]))
    names = np.array([f"m{k:05d}" for k in range(n_models)])
    rows = pd.DataFrame({"item_id": rng.integers(0, max(n // 20, 2), n), "model_a": names[a], "model_b": names[b], "winner": np.where(rng.random(n) < 0.1, "tie", np.where(won, names[a], names[b])), "seq": np.arange(n)})
    return spark.createDataFrame(rows)


@pytest.mark.parametrize(("resample", "order"), [("items", []), ("comparisons", []), ("items", ["seq"])])
def test_a_large_board_is_fitted_as_a_listed_one(spark, monkeypatch, resample, order):
    rows = games(spark, 9, 700)
    listed = bradley_terry(rows, n_boot=40, seed=3, resample=resample, order=order)
    monkeypatch.setattr(pw, "LISTED", 4)
    monkeypatch.setattr(pw, "BLOCK", 4)
    large = bradley_terry(rows, n_boot=40, seed=3, resample=resample, order=order)
    assert large.n_boot_usable == listed.n_boot_usable == 40
    numbers = ["rating", "ci_low", "ci_high", "n_comparisons"]
    assert large.ratings["model"].tolist() == listed.ratings["model"].tolist()
    assert np.allclose(large.ratings[numbers], listed.ratings[numbers], atol=1e-7)
    pairs = large.pairs.toPandas().sort_values(["model_a", "model_b"]).reset_index(drop=True)
    want = listed.pairs.sort_values(["model_a", "model_b"]).reset_index(drop=True)
    assert pairs[["model_a", "model_b", "separable"]].equals(want[["model_a", "model_b", "separable"]])
    assert np.allclose(pairs[["difference", "ci_low", "ci_high", "p_a_beats_b", "n_head_to_head"]], want[["difference", "ci_low", "ci_high", "p_a_beats_b", "n_head_to_head"]].astype(float), atol=1e-7)
    assert large.n_separable == listed.n_separable == large.separable_pairs.count()
    assert large.win_matrix.count() == 72 and large.summary() == listed.summary()
    elo = to_elo(large).pairs.agg(F.max("difference")).first()[0]
    assert elo == pytest.approx(400 / np.log(10) * want["difference"].max())


def test_four_hundred_models(spark):
    rows = games(spark, 400, 12_000)
    r = bradley_terry(rows, n_boot=6, seed=1)
    assert len(r.ratings) == 400 and r.n_boot_usable == 6 and r.n_pairs == 79_800
    assert r.ratings["ci_low"].notna().all() and (r.ratings["ci_low"] <= r.ratings["ci_high"]).all()
    assert r.pairs.where("difference >= 0 AND ci_low <= ci_high").count() == 79_800
