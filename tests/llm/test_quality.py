import numpy as np

from plumbline.llm import common, quality
from plumbline.llm.features import NAMES, features
from plumbline.llm.queries import op5_quality


def test_features_of_odd_texts(monkeypatch):
    for text in (None, "", " \n\t "):
        assert (features(text) == 0).all()
    x = dict(zip(NAMES, features("One one! one one 12 | Two\nOne"), strict=True))
    assert np.isclose(x["log_words"], np.log1p(8)) and np.isclose(x["distinct_words"], 6 / 8) and np.isclose(x["commonest_word"], 2 / 8) and np.isclose(x["repeated_word"], 1 / 8)
    assert np.isclose(x["distinct_lines"], 1) and np.isclose(x["lines_a_word"], 2 / 8) and np.isclose(x["capitalised_words"], 3 / 8)
    text = "alpha beta Gamma, 12 " * 200
    whole = features(text)
    monkeypatch.setattr(common, "BLOCK", 840)
    parts = features(text)
    assert np.isfinite(parts).all() and np.allclose(whole[[0, 1, 2, 3, 7, 8, 9]], parts[[0, 1, 2, 3, 7, 8, 9]])


def test_additive_and_pairwise_effects_are_learned():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # neither feature tells anything alone
    model = quality.fit(x, y)
    assert ((model(x) > 0.5) == y).mean() > 0.95
    assert model.pairs[0] == (0, 1)
    y = (x[:, 2] > 0.3).astype(float)
    assert ((quality.fit(x, y)(x) > 0.5) == y).mean() > 0.97


def test_one_label_or_none():
    x = np.zeros((5, 2))
    assert (quality.fit(x, np.ones(5))(x) > 0.9).all() and (quality.fit(x, np.zeros(5))(x) < 0.1).all()
    assert np.allclose(quality.fit(np.zeros((0, 2)), np.zeros(0))(x), 0.5)


def test_held_out_and_odd_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op5_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 500 and np.mean([x.predicted == x.quality for x in got]) > 0.97
    rows = [(1, "good words here", 1), (1, "good words here", 1), (2, None, None), (None, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, features int")
    told = spark.createDataFrame([(1, 1), (1, None), (2, 5), (None, 0), (9, 1)], "doc_id long, quality int")
    model = quality.fitted(docs, told)
    out = quality.scored(docs.select("doc_id", "text"), model).collect()
    assert len(out) == 4 and all(0 <= x.score <= 1 for x in out)
    assert quality.scored(docs.limit(0).select("doc_id", "text"), quality.fitted(docs.limit(0), told.limit(0))).count() == 0


def plain_tree(bins, g, h, width):
    """Step function over bins, the best cut of any part first, all by sums over rows."""
    total = lambda x, a, b: sum(v for k, v in zip(bins, x, strict=True) if a <= k < b)
    size = lambda a, b: sum(a <= k < b for k in bins)
    parts = [(0, width)]
    while len(parts) < quality.LEAVES:
        best = []
        for a, b in parts:
            for at in range(a + 1, b):
                if size(a, at) >= quality.LEAST and size(at, b) >= quality.LEAST:
                    gain = sum(total(g, *p) ** 2 / (total(h, *p) + 1) for p in ((a, at), (at, b))) - total(g, a, b) ** 2 / (total(h, a, b) + 1)
                    best.append((gain, -at, (a, b)))
        if not best or max(best)[0] <= 1e-9:
            break
        _, at, (a, b) = max(best)
        parts.remove((a, b))
        parts += [(a, -at), (-at, b)]
    return [next(total(g, a, b) / (total(h, a, b) + 1) for a, b in parts if a <= k < b) for k in range(width)]


def test_a_plain_fit_agrees(monkeypatch):
    """Boosted tables against trees fitted row by row, and scores against sums of single look-ups."""
    monkeypatch.setattr(quality, "PAIRS", 0)
    monkeypatch.setattr(quality, "ROUNDS", 6)
    r = np.random.default_rng(3)
    x = np.column_stack((r.normal(0, 1, 160), r.integers(0, 5, 160), r.exponential(1, 160)))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(0, 1, 160) > 1).astype(float)
    model = quality.fit(x, y)
    weight = [0.5 / y.mean() if t else 0.5 / (1 - y.mean()) for t in y]
    edges = [sorted(set(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1]))) for c in x.T]
    bins = [[sum(e <= v for e in es) for v in c] for es, c in zip(edges, x.T, strict=True)]
    z = [0.0] * 160
    for _ in range(6):
        for k in range(3):
            p = [1 / (1 + np.exp(-v)) for v in z]
            g, h = [w * (t - q) for w, t, q in zip(weight, y, p, strict=True)], [w * q * (1 - q) for w, q in zip(weight, p, strict=True)]
            step = plain_tree(bins[k], g, h, len(edges[k]) + 1)
            z = [v + quality.RATE * step[b] for v, b in zip(z, bins[k], strict=True)]
    assert np.allclose(model(x), 1 / (1 + np.exp(-np.array(z))))


def test_scores_are_sums_of_look_ups():
    r = np.random.default_rng(5)
    x = r.random((500, 3))
    model = quality.fit(x, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float))
    for row, got in zip(x[:60], model(x[:60]), strict=True):
        z = model.base + sum(table[sum(e <= v for e in edges)] for v, edges, table in zip(row, model.edges, model.tables, strict=True))
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            z += table[sum(e <= row[a] for e in model.pair_edges[a]), sum(e <= row[b] for e in model.pair_edges[b])]
        assert np.isclose(got, 1 / (1 + np.exp(-z)))


def test_a_clashing_name_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000, "x"), (2, "a" * 300_000, None)], "doc_id long, text string, score string")
    out = quality.scored(docs, quality.fit(np.zeros((0, len(NAMES))), np.zeros(0)))
    assert out.columns == ["doc_id", "score", "_score"] and {r._score for r in out.collect()} == {0.5}
