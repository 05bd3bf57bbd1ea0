import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_model as lm
from plumbline.llm.common import remainder
from plumbline.llm.language_model import CONTEXTS, Seating, counts, fitted, head, log_stirling, planes, scored, seated, uncounts, unplanes


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "\n"]


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(60)]
    texts = [" ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=r.randint(0, 60))) + f" own{i % 90}" for i in range(300)]
    return list(enumerate(texts)) + [(400, None), (401, ""), (402, " \n"), (403, "W0É W0é w0é"), (404, "never seen at all"), (3, texts[3]), (None, "w1é w2é")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", remainder(F.col("doc_id"), 10) == 0).repartition(3)


def buckets_of(model):
    """Each bucket's row and what the shards sent it."""
    sent = [r.asDict() for r in model.restaurants.where(f"bucket <> {lm.WHOLE}").collect()]
    return [(r, [x for x in sent if x["bucket"] == r["bucket"]]) for r in (row.asDict() for row in model.state.collect())]


@pytest.fixture(scope="module")
def model(spark):
    return fitted(frame(spark, corpus()).where("NOT held_out"))


def test_planes():
    y = np.array([1, 0, 254, 255, 2**40, 3, 256])
    assert uncounts(counts(y)).tolist() == y.tolist() and len(uncounts(counts(y[:0]))) == 0
    x = np.array([0, 1, 255, 256, 70000, 2**31])
    assert unplanes(planes(x)).tolist() == x.tolist() and unplanes(planes(x[:3], "u1"), "u1").tolist() == [0, 1, 255]


def test_counts_and_base(spark, model):
    rows = corpus()
    train = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(train.values()), len(train)
    got = scored(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and {x.train_tokens for x in got} == {n}
    texts = dict(rows)
    for x in got:
        w = words(texts[x.doc_id])
        assert x.held_out == held(x.doc_id) and x.n_tokens == len(w) and x.n_known == sum(t in train for t in w)
        assert math.isclose(x.base_score, sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), rel_tol=1e-9)
        assert x.score < 0
    out = [x for x in got if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)


def test_bucket_and_head_paths_agree(spark, model, monkeypatch):
    docs = frame(spark, corpus())
    key = lambda x: (str(x.doc_id), x.n_tokens)
    results = []
    for share in (1e-9, 2.0):  # all words at home, and none
        monkeypatch.setattr(head, "__defaults__", (share,))
        results.append(sorted(scored(docs, model).collect(), key=key))
    for a, b in zip(*results, strict=True):
        assert a[:5] == b[:5] and math.isclose(a.score, b.score, rel_tol=1e-9) and math.isclose(a.base_score, b.base_score, rel_tol=1e-9)


def test_probabilities_sum_to_one(model):
    total = np.zeros(CONTEXTS)
    for row, sent in buckets_of(model):
        s, probability = lm._averaged(row, model.samples, sent, model.buckets)
        for w in range(len(s.words)):
            total += probability(np.full(CONTEXTS, w), np.arange(CONTEXTS))
    _, probability = lm._averaged(None, model.samples)
    total += probability(np.full(CONTEXTS, -1), np.arange(CONTEXTS))
    assert np.allclose(total, 1)


def test_tables_have_their_conditional():
    """Weights of all ways to seat five customers, by brute force over their choices."""
    d, weight, p = 0.6, 3.0, 0.2
    exact = np.zeros(6)
    for choices in itertools.product(range(5), repeat=5):
        sizes, w = [], 1.0
        for c in choices:
            if c < len(sizes):
                w *= sizes[c] - d
                sizes[c] += 1
            elif c == len(sizes):
                w *= (weight + d * len(sizes)) * p
                sizes.append(1)
            else:
                w = 0
        exact[len(sizes)] += w
    exact /= exact.sum()
    n = 40_000
    got = seated(np.full(n, 5), np.full(n, weight), d, np.full(n, p), np.random.default_rng(1), log_stirling(d))
    assert np.allclose(np.bincount(got, minlength=6) / n, exact, atol=0.01)
    one = seated(np.array([0, 1, 2, 10_000]), np.full(4, weight), d, np.full(4, 1e-9), np.random.default_rng(1), log_stirling(d))
    assert one.tolist()[:2] == [0, 1] and one[3] < 60
    many = seated(np.full(300, 2000), np.full(300, weight), d, np.ones(300), np.random.default_rng(2), log_stirling(d))
    t = [1.0]
    for i in range(1, 2000):
        t.append(t[-1] + (weight + d * t[-1]) / (i + weight))
    assert abs(many.mean() / t[-1] - 1) < 0.1


def test_seating_keeps_its_sums():
    r = np.random.default_rng(3)
    per = r.integers(1, 20, 30)
    contexts = np.concatenate([np.sort(r.choice(CONTEXTS, k, replace=False)) for k in per])
    s = Seating(np.arange(30, dtype=np.uint64), per, contexts, r.integers(1, 90, per.sum()))
    settings = lm.Settings.of(s.totals())
    stirling = [log_stirling(d) for d in settings.discounts]
    for _ in range(3):
        s.sweep(settings, r, stirling)
        assert (s.t1 >= 1).all() and (s.t1 <= s.n).all() and (s.t2 >= 1).all() and (s.t2 <= s.c2).all() and (s.t3 >= 1).all() and (s.t3 <= s.c3).all()
        settings = settings.renewed(s.totals())


def test_empty(spark):
    docs = frame(spark, corpus())
    none = fitted(docs.limit(0))
    got = scored(docs, none).collect()
    assert len(got) == len(corpus()) and all(x.score == 0 and x.base_score == 0 and x.train_tokens == 0 and x.n_known == 0 for x in got)
    assert scored(docs.limit(0), none).count() == 0


def test_each_context_word_has_its_own_followers(spark):
    """More context words than any fixed number of shared restaurants tells apart."""
    pairs = 1500
    docs = frame(spark, [(i, f"c{i} f{i} c{i} f{i}") for i in range(pairs)]).withColumn("held_out", F.lit(False))
    asked = [(i, f"c{i} f{i}") for i in range(pairs)] + [(pairs + i, f"c{i} f{(i + 1) % pairs}") for i in range(pairs)]
    got = {r.doc_id: r.score for r in scored(frame(spark, asked), fitted(docs)).collect()}
    assert all(got[i] > got[pairs + i] + 0.5 for i in range(pairs))


def test_seen_contexts_sum_to_one_over_all_buckets(model):
    """The totals of a restaurant cover its words in all buckets."""
    rows = buckets_of(model)
    contexts = np.unique(np.concatenate([lm._seating(r)[0].contexts for r, _ in rows]))
    totals = {int(k): x for r in model.restaurants.where(f"bucket = {lm.WHOLE}").collect() for k, *x in zip(lm.unascending(r.leaves), *(uncounts(s) for s in r.sums), strict=True)}
    assert sorted(totals) == contexts.tolist()
    assert all(len(x) == 2 + len(model.samples) for x in totals.values())
    c, *t = (np.array([totals[int(k)][j] for k in contexts]) for j in range(1 + len(model.samples)))
    total = np.zeros(len(contexts))
    for row, sent in [*rows, (None, [])]:
        s, probability = lm._averaged(row, model.samples, sent, model.buckets)
        for w in range(len(s.words)) if row else [-1]:
            leaf = lm.found(s.leaves, contexts)
            p, above = probability(np.full(len(contexts), w), contexts, leaf)
            shard = sum((x.strengths[0] + x.discounts[0] * y) * a / (x.strengths[0] + c) for x, y, a in zip(model.samples, t, above, strict=True)) / len(t)
            total += np.where(leaf >= 0, p, shard)
    assert np.allclose(total, 1)


def test_log_gamma_and_evidence():
    x = np.array([1e-3, 0.03, 0.5, 1, 1.5, 7.99, 8, 100, 1e9])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)
    c, t = np.array([5, 3, 0]), np.array([2, 3, 0])
    got = lm.tables_evidence(c, t)
    for i, d in enumerate(lm.DISCOUNTS):
        for j, s in enumerate(lm.STRENGTHS):
            want = sum(sum(math.log(s + d * k) for k in range(1, b)) - sum(math.log(s + k) for k in range(1, a)) for a, b in ((5, 2), (3, 3)))
            assert math.isclose(got[i, j], want, rel_tol=1e-9, abs_tol=1e-9)


def test_settings_find_the_discount_and_strength_they_came_from():
    """Restaurants seated one customer at a time by known settings, every dish drawn at its first table."""
    r, d, strength = np.random.default_rng(4), 0.6, 5.0
    customers, tables, n_all, t_all = [], [], [], []
    for _ in range(1500):
        sizes = []
        for i in range(r.integers(1, 60)):
            if r.random() < (strength + d * len(sizes)) / (strength + i):
                sizes.append(1)
            else:
                sizes[r.choice(len(sizes), p=(np.array(sizes) - d) / (i - d * len(sizes)))] += 1
        dish = r.integers(0, 40, len(sizes))
        n, t = np.bincount(dish, sizes, 40).astype(int), np.bincount(dish, minlength=40)
        customers.append(n.sum())
        tables.append(t.sum())
        n_all += n[n > 0].tolist()
        t_all += t[n > 0].tolist()
    n, t = np.array(n_all), np.array(t_all)
    totals = np.zeros(lm.TOTALS)
    totals[lm.TOKENS] = n.sum()
    totals[lm.PARENT : lm.PARENT + 2 * lm.PARENTS] = 10
    totals[lm.ROOT : lm.ROOT + 2] = 10
    totals[lm.DISH_EVIDENCE :] = lm._stirlings()[:, n, t].sum(axis=1)
    got = lm.Settings.of(totals).resampled(lm.tables_evidence(np.array(customers), np.array(tables)), r)
    assert abs(got.discounts[0] - d) < 0.03 and abs(math.log(got.strengths[0] / strength)) < 0.3


def test_a_plain_sampler_agrees():
    """One customer at a time over restaurants of lists of tables, against sweeps over numbers of tables."""
    r = np.random.default_rng(7)
    n_words, d, strength = 6, (0.5, 0.4, 0.3), (1.5, 0.7, 2.0)
    contexts = (np.arange(8) % 2).astype(np.uint64) << lm.PARENT_BIT | np.arange(1000, 1008, dtype=np.uint64)
    tokens = [(int(c), int(w)) for c in range(8) for w in r.choice(n_words, 9, p=[0.4, 0.25, 0.15, 0.1, 0.05, 0.05])]
    seen = sorted({w for _, w in tokens})
    uniform = 1 / (len(seen) + 1)
    above = {("c", c): ("p", c % 2) for c in range(8)} | {("p", k): "root" for k in range(2)}
    level = lambda u: 2 if u == "root" else 1 if u[0] == "p" else 0
    seats = {u: {w: [] for w in range(n_words)} for u in [*above, "root"]}

    def prob(u, w):
        k, sizes = level(u), seats[u]
        base = uniform if u == "root" else prob(above[u], w)
        total, n_tables = sum(sum(x) for x in sizes.values()), sum(len(x) for x in sizes.values())
        return (sum(sizes[w]) - d[k] * len(sizes[w]) + (strength[k] + d[k] * n_tables) * base) / (strength[k] + total)

    def add(u, w):
        k, sizes = level(u), seats[u][w]
        base = uniform if u == "root" else prob(above[u], w)
        new = (strength[k] + d[k] * sum(len(x) for x in seats[u].values())) * base
        weights = np.array([*(s - d[k] for s in sizes), new])
        at = r.choice(len(weights), p=weights / weights.sum())
        if at < len(sizes):
            sizes[at] += 1
        else:
            sizes.append(1)
            if u != "root":
                add(above[u], w)

    def remove(u, w):
        sizes = seats[u][w]
        at = r.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[at] -= 1
        if not sizes[at]:
            sizes.pop(at)
            if u != "root":
                remove(above[u], w)

    for c, w in tokens:
        add(("c", c), w)
    plain, rounds = np.zeros((8, n_words)), 500
    for k in range(rounds + 50):
        for c, w in tokens:
            remove(("c", c), w)
            add(("c", c), w)
        if k >= 50:
            plain += [[prob(("c", c), w) for w in range(n_words)] for c in range(8)]

    pairs = Counter(tokens)
    rows = sorted((w, contexts[c], n) for (c, w), n in pairs.items())
    s = Seating(np.array(seen, np.uint64), np.bincount([seen.index(w) for w, _, _ in rows]), np.array([c for _, c, _ in rows], np.uint64), np.array([n for _, _, n in rows]))
    settings, stirling, got = lm.Settings(d, strength, s.totals()), [log_stirling(x) for x in d], np.zeros((8, n_words))
    for k in range(3000):
        s.sweep(settings, r, stirling)
        s.leaf_tables, settings = s.by_leaf(s.t1), settings.renewed(s.totals())
        if k >= 50:
            predicted = s.predictor(settings)
            for j, w in enumerate(seen):
                places = s.find(np.full(8, j), contexts, lm.found(s.leaves, contexts))
                got[:, w] += predicted(places, contexts)[1]
    plain, got = plain / rounds, got / 2950
    assert np.abs(np.log(got[:, seen] / plain[:, seen])).mean() < 0.06 and np.abs(got[:, seen] - plain[:, seen]).max() < 0.04
