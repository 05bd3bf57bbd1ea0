import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import line_rules as lr
from plumbline.llm.queries import op11_line_rules

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n, repeated = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


def texts():
    r = random.Random(8)
    words = ["a", "b", "Zoë", "#", "**", "日本", "x|y", "9", "c.", "<p>", "\x1c", "no break", " "]
    out = ["".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "\t", "\r\n", "\n\n", "\x0b"]) for _ in range(r.randint(0, 150))) for _ in range(120)]
    return [*out, None, "", " ", "\n", "\n\n \n", "a", "a b c a b c", "same\nsame\n same\nsame", "w " * 60, *out[:5]]


def rated(spark, docs, field=None, more="extra int, KEPT string", **options):
    rows = [(k, t, 1, "clash") for k, t in enumerate(docs)]
    return lr.rated(spark.createDataFrame(rows, f"doc_id long, text string, {more}"), field, **options)


@pytest.mark.parametrize("block", [1 << 21, 50])
def test_counts_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lr, "BLOCK", block)
    docs = texts()
    df = rated(spark, docs).orderBy("doc_id")
    assert df.columns == ["doc_id", "text", "extra", *lr.COUNTS, "base_failed", "kept", "content_words", "boilerplate_lines"]
    for r in df.collect():
        want = plain(docs[r.doc_id])
        assert (*(r[c] for c in lr.COUNTS), r.base_failed) == want
        assert r.kept == (not want[-1]) and r.content_words == want[0] and r.boilerplate_lines == []


def field(seed, width=len(lr.FEATURES)):
    r = np.random.default_rng(seed)
    return lr.Field(np.zeros(width), np.ones(width), r.normal(size=width + 1), r.normal(size=(2, 2)), float(r.normal()))


def test_decoding_is_the_best_of_all_sequences():
    r = np.random.default_rng(3)
    sizes = [1, 2, 3, 7, 9, 1]
    text, features = np.repeat(np.arange(len(sizes)), sizes), r.normal(size=(sum(sizes), len(lr.FEATURES)))
    for seed in range(6):
        f = field(seed)
        got, e = lr.decoded(f, features, text), f.evidence(features)
        for k in range(len(sizes)):
            own = e[text == k]
            score = lambda y: y[0] * f.first + sum(v * x for v, x in zip(y, own)) + sum(f.after[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, B905, E731
            best = max(itertools.product((0, 1), repeat=len(own)), key=score)
            assert got[text == k].astype(int).tolist() == list(best)


def test_likelihood_and_gradient_match_enumeration():
    r = np.random.default_rng(4)
    sizes, width = [1, 4, 3, 2], 3
    real = np.arange(4)[None] < np.array(sizes)[:, None]
    z, labels, theta = r.normal(size=(4, 4, width)) * real[..., None], r.integers(0, 2, (4, 4)), r.normal(size=width + 5)

    def value(theta):
        after, total = theta[width : width + 4].reshape(2, 2), 0.0
        for k, size in enumerate(sizes):
            score = lambda y: y[0] * theta[-1] + sum(v * (z[k, t] @ theta[:width]) for t, v in enumerate(y)) + sum(after[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, B905, E731
            total += score(labels[k, :size]) - np.log(sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=size)))
        return total

    got, gradient = lr.likelihood(z, labels, real, theta)
    assert got == pytest.approx(value(theta))
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-6
        assert gradient[k] == pytest.approx((value(theta + step) - value(theta - step)) / 2e-6, abs=1e-6)


def test_the_query_judges_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op11_line_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (*(r[c] for c in lr.COUNTS), r.base_failed) == plain(docs[r.doc_id])
        assert not (r.kept and (r.base_failed or 2 * r.content_words < r.n_words))
    told = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and not r.base_failed]
    assert np.mean([q == kept for q, kept in told]) > 0.97


def test_lines_of_both_kinds_in_one_text(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    f = lr.fitted(docs, labels)
    good = "The quick words of this line are plain and end as they should.\n" * 1 + "\n".join(f"Here another line number {w} goes on in plain words." for w in ("one", "two", "three", "four"))
    poor = "\n".join("BUY!! NOW!! ### *** $$$ %%% | | CHEAP!! &&& |" for _ in range(5))
    r = rated(spark, [good, poor, good + "\n" + poor], f).orderBy("doc_id").collect()
    assert r[0].boilerplate_lines == [] and r[1].boilerplate_lines == [0, 1, 2, 3, 4]
    assert set(r[2].boilerplate_lines) == {5, 6, 7, 8, 9}


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert lr.fitted(docs, labels) is None
    assert rated(spark, []).collect() == []


def test_a_very_long_text(spark):
    text = "\n".join(f"line {k} of a text that goes on" for k in range(60_000))
    r = rated(spark, [text], field(1)).first()
    assert r.n_words == 8 * 60_000 and r.n_dup_lines == 0 and r.n_repeat_words == plain(text)[4]
