import numpy as np

from plumbline.llm.features import features
from plumbline.llm.queries import op8_toxicity
from plumbline.llm.toxicity import BALANCE, FOLDS, LEAST, RIDGE, SCREEN, all_tokens, fit, fitted, learned, parts, scored, telling


def test_parts():
    assert parts("abc") == ["=abc"] and parts("abcdef") == ["=abcdef", "^abcd", "^abcde"]


def test_later_models_use_earlier_categories():
    r = np.random.default_rng(1)
    plain = [f"w{i}" for i in "abcdefghij"]
    texts, y = [], []
    for _ in range(600):
        insult, threat = r.random() < 0.4, False
        words = r.choice(plain, 30).tolist()
        if insult:
            words.append(r.choice(["vileworm", "vilerat", "vileone"]))
            threat = r.random() < 0.5
        if threat:
            words.append("beware")
        elif r.random() < 0.3 and not insult:
            words.append("beware")  # tells a threat only together with an insult
        texts.append(" ".join(words))
        y.append([insult, threat])
    y = np.array(y, float)
    chain = learned([all_tokens(t) for t in texts], np.array([features(t) for t in texts]), y, ["insult", "threat"], np.arange(len(texts)) % FOLDS)
    p = chain(texts)
    assert ((p > 0.5) == y).mean(axis=0).min() > 0.97
    assert chain(["wa wb a vilesnake wc"])[0, 0] > 0.5 and chain(["wa wb wc"])[0, 0] < 0.5
    assert len(chain.models[1].weights) == len(chain.models[0].weights) - len(chain.models[0].names) + len(chain.models[1].names) + 1


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "", None), (3, "a " * 30, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    chain = fitted(docs.select("doc_id", "text"), labels, ["toxic"])
    clash = scored(docs, chain)
    assert clash.columns == ["doc_id", "toxic_score", "_toxic_score"] and clash.where("toxic_score = 'x'").count() == 4
    out = scored(docs.select("doc_id", "text"), chain).collect()
    assert len(out) == 5 and all(0 <= x.toxic_score <= 1 for x in out)
    empty = fitted(docs.limit(0).select("doc_id", "text"), labels.limit(0), ["toxic"])
    assert {x.toxic_score for x in scored(docs.select("doc_id", "text"), empty).collect()} == {0.5}
    assert scored(docs.limit(0).select("doc_id", "text"), empty).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "told"), "doc_id").where("held_out").collect()
    toxic, clean = [x.toxic for x in got if x.told == 1], [x.toxic for x in got if x.told == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02


def cases(n=400):
    r = np.random.default_rng(2)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    texts = [" ".join(r.choice(words, r.integers(1, 40))) for _ in range(n)] + ["", None, "Wau " * 3000]
    y = np.array([[("wau" in t.lower()) ^ (r.random() < 0.2), "wbv" in t and "wcx" in t] for t in (t or "" for t in texts)], float)
    return texts, y


def test_a_model_is_the_maximum_of_its_likelihood():
    texts, y = cases()
    tokens, dense = [all_tokens(t) for t in texts], np.array([features(t) for t in texts])
    m = fit(tokens, dense, y[:, 0])
    assert "=wau" in m.names
    slope, base, mean = np.zeros(len(m.weights)), 0.0, y[:, 0].mean()
    for t, d, label in zip(tokens, dense, y[:, 0], strict=True):
        x = np.array([name in t for name in m.names], float)
        x = np.concatenate((x, np.clip((d - m.centre) / m.scale, -4, 4)))
        p = 1 / (1 + np.exp(-(m.base + x @ m.weights)))
        miss = ((0.5 / mean) if label else (0.5 / (1 - mean))) ** BALANCE * (p - label)
        slope, base = slope + miss * x, base + miss
    assert np.abs(slope + RIDGE * m.weights).max() < 1e-4 and abs(base) < 1e-4


def test_a_batch_is_scored_as_a_plain_chain():
    texts, y = cases()
    chain = learned([all_tokens(t) for t in texts], np.array([features(t) for t in texts]), y, ["a", "b"], np.arange(len(texts)) % FOLDS)
    got = chain(texts)
    for t, row in zip(texts, got, strict=True):
        before = []
        for m, p in zip(chain.models, row, strict=True):
            dense = np.concatenate((features(t), before))
            odds = m.base + sum(m.weights[k] for name, k in m.names.items() if name in all_tokens(t)) + np.clip((dense - m.centre) / m.scale, -4, 4) @ m.weights[len(m.names) :]
            before.append(np.clip(odds, -30, 30))
            assert np.isclose(p, 1 / (1 + np.exp(-before[-1])))
    assert np.allclose(got, np.concatenate([chain([t]) for t in texts]))


def test_no_fit_is_told_by_rows_it_leaves_out(spark):
    texts, y = cases(300)
    fold = np.arange(len(texts)) % FOLDS
    rows = spark.createDataFrame([(t, int(f), *map(int, ys)) for t, f, ys in zip(texts, fold, y, strict=True)], "text string, fold long, a int, b int")
    want = set()
    for out in (None, *range(FOLDS)):
        inside = [k for k in range(len(texts)) if fold[k] != out]
        for c in range(2):
            yes = [all_tokens(texts[k]) for k in inside if y[k, c]]
            no = [all_tokens(texts[k]) for k in inside if not y[k, c]]
            for t in set().union(*yes, *no):
                p, q = sum(t in x for x in yes), sum(t in x for x in no)
                share = (p + q) / len(inside)
                if p + q >= LEAST and abs(p / len(yes) - q / len(no)) >= SCREEN * np.sqrt(share * (1 - share) * (1 / len(yes) + 1 / len(no))):
                    want.add(t)
    assert telling(rows, ["a", "b"]) == want and want
