import itertools
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import langid
from plumbline.llm.langid import Identifier, Index, fitted, identified, in_known_language, learned, log_probabilities, log_probability, parts_of, runs, vocabulary
from plumbline.llm.queries import op7_langid, pieces_path

PIECES = {"▁": 2, "▁a": 3, "a": 4, "b": 5, "ab": 6, "ba": 7, "▁ab": 8, "aba": 9}


def segmentations(s):
    if not s:
        yield ()
    for n in range(1, len(s) + 1):
        if s[:n] in PIECES or n == 1:
            for rest in segmentations(s[n:]):
                yield (PIECES.get(s[:n], 1), *rest)


def test_forward_sums_all_segmentations():
    p = np.random.default_rng(1).random((10, 3)) / 10
    p[0] = 0
    words = ["a", "b", "ab", "aba", "abba", "xab", "axb", "ababab"]
    got = log_probabilities(words, Index(PIECES), p)
    for w, row in zip(words, got, strict=True):
        want = sum(np.prod(p[list(s)], axis=0) for s in segmentations("▁" + w))
        assert np.allclose(np.exp(row), want)


@pytest.mark.parametrize("at_once", [8192, 7])
def test_a_long_run_is_summed_whole(at_once, monkeypatch):
    r = np.random.default_rng(3)
    p = r.random((10, 3)) / 10
    p[0] = 0
    word = "".join(r.choice(list("abx"), 10_000))
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    got = log_probabilities([word, "ab"], Index(PIECES), p)[0]
    s, alpha, scale = "▁" + word, [np.ones(3)], 0.0
    for j in range(1, len(s) + 1):
        alpha.append(sum(alpha[j - n] * p[PIECES.get(s[j - n : j], 1 if n == 1 else 0)] for n in range(1, min(j, 3) + 1)))
        if j % 20 == 0:
            scale += np.log(alpha[-1])
            alpha[-3:] = [a / alpha[-1] for a in alpha[-3:]]
    assert np.allclose(got, scale + np.log(alpha[-1]), rtol=1e-9)
    assert np.allclose(log_probability("abab", Index(PIECES), p), log_probabilities(["abab"], Index(PIECES), p)[0])


def test_texts_of_one_long_run():
    langs, p = learned({"x": Counter({"ab": 9, "aba": 2}), "y": Counter({"ba": 4, "bb": 3})}, PIECES)
    use = Identifier(langs, p, PIECES)
    for text in ("ab" * 5000, "b" * 9999 + " bb", "ba " + "aab" * 700 + " ab"):
        want = sum(log_probability(w, use.index, p) for w in text.split())
        assert use([text])[0][0] == langs[int(want.argmax())]
    assert all("ab" * 5000 != w for w in use.known)


def test_index_finds_each_piece_and_nothing_else():
    pieces = vocabulary(pieces_path())
    index = Index(pieces)
    assert index(index.keys[2:]).tolist() == list(range(2, len(pieces) + 2))
    r = np.random.default_rng(1)
    assert not index(r.integers(0, 2**63, (3, 5000)).astype(np.uint64)).any()


def test_expectations_match_enumeration():
    counts = {"x": Counter({"ab": 3, "aba": 2, "cab": 1}), "y": Counter({"ba": 4, "ab": 1})}
    langs, p = learned(counts, PIECES, rounds=2)
    q = np.full((10, 2), 1 / 9)
    q[0] = 0
    for _ in range(2):
        got = np.zeros_like(q)
        for lang, name in enumerate(langs):
            for w, n in counts[name].items():
                parts = [(s, np.prod(q[list(s), lang])) for s in segmentations("▁" + w)]
                total = sum(x for _, x in parts)
                for s, x in parts:
                    for k in s:
                        got[k, lang] += n * x / total
        got[1:] += 0.01
        q = got / got.sum(axis=0)
    assert langs == ["x", "y"] and np.allclose(p, q)


def test_runs():
    assert runs("Éa1b_c d-½x 日本") == ["éa", "b", "c", "d", "x", "日本"]
    assert runs("1 2 ½ _ !") == [] and runs(None) == []
    assert [len(w) for w in runs("z" * 95)] == [95] and [len(w) for w in parts_of(runs("z" * 95 + " y"))] == [40, 40, 15, 1]


def test_worker_forgets_and_agrees(monkeypatch):
    langs, p = learned({"x": Counter({"ab": 9, "aba": 2}), "y": Counter({"ba": 4, "bb": 3})}, PIECES)
    texts = ["".join(x) for x in itertools.product("ab ", repeat=4)]
    whole = Identifier(langs, p, PIECES)(texts)
    monkeypatch.setattr(langid, "REMEMBERED", 2)
    use = Identifier(langs, p, PIECES)
    assert [use([t])[0] for t in texts] == whole


def test_nulls_extra_columns_and_empty(spark):
    rows = [(i, t, x, "q") for i, (t, x) in enumerate([("the cat sat on the mat and that", "en"), ("der hund und die katze nicht", "de"), (None, "en"), ("", "de"), ("123 !", None), ("the and that cat", None)] * 3)] + [(None, "und die katze", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    use = fitted(docs, pieces_path())
    got = {x.doc_id: x for x in identified(docs, use, "l", "s").collect()}
    assert [got[i].l for i in (0, 1, 2, 3, 4, 5, None)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert all(0 <= x.s <= 1 for x in got.values()) and got[2].s == 0
    kept = in_known_language(docs, use)
    assert kept.schema == docs.schema and kept.count() == 10
    blank = fitted(docs.limit(0), pieces_path())
    assert {x.l for x in identified(docs, blank, "l", "s").collect()} == {"und"}
    assert identified(docs.limit(0), use, "l", "s").count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op7_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert np.mean([x.lang_pred == x.lang for x in got]) > 0.97


def test_vocabulary_is_of_letters():
    pieces = vocabulary(pieces_path())
    assert len(pieces) > 10_000 and min(pieces.values()) == 2 and all(p.removeprefix("▁").isalpha() for p in pieces if p != "▁")
