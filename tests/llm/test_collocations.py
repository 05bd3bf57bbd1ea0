import random
import re
from collections import Counter

import pytest

from plumbline.llm import collocations as co

DOCS = "doc_id long, text string, lang string, phrase string, score long"


def plain(docs, least, longest, most, share):
    """Everything counted in dictionaries."""
    counts, sizes = {}, Counter()
    for text, lang in docs:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    rows = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if a >= least}
        scored = []
        for g, a in found.items():
            if len(g) < 2:
                continue
            inside = any(len(q) > len(g) and 100 * b >= share * a and any(q[i : i + len(g)] == g for i in range(len(q) - len(g) + 1)) for q, b in found.items())
            if inside:
                continue
            score, _, left, right = min((1000 * a * sizes[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), left, right))
        rows += [(lang, k, p.decode(), -a, left, right, sizes[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(rows)


def corpus():
    r = random.Random(4)
    words = ["a", "B", "c", "é", "dd", "ÉT", "x-y", "\x00z", "İ", "w\x1cw"]
    docs = []
    for k in range(150):
        text = "".join(r.choice(words) + r.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!? "]) for _ in range(r.randint(0, 60)))
        docs.append((text, r.choice(["en", "de", None, "und"])))
    docs += [("new york city " * 7, "en"), ("New York, new york city\nnew york", "en"), (None, "en"), ("", None), ("...", "fr"), ("lone", "fr"), ("a b a b a b a", "en")]
    return docs + docs[:20]


def table(spark, docs):
    return spark.createDataFrame([(k, t, lang, "clash", 1) for k, (t, lang) in enumerate(docs)], DOCS)


@pytest.mark.parametrize(("least", "longest", "most", "share"), [(5, 5, 2000, 100), (3, 3, 7, 60), (2, 2, 50, 100), (4, 4, 10, 80)])
def test_matches_brute_force(spark, least, longest, most, share):
    docs = corpus()
    got = co.collocations(table(spark, docs), least, longest, most, share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(docs, least, longest, most, share)


def test_blocks_and_small_bitmaps_change_nothing(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(co, "BLOCK", 64)
    texts = [t.encode() for t, _ in docs if t]
    for sizes in ((1, 1), (2, 2), (3, 5)):
        whole = Counter()
        for block in (10**9, 64):
            monkeypatch.setattr(co, "BLOCK", block)
            counts, words, carried = Counter(), co._Words("en", None), []
            for new in co._blocks(texts):
                both = carried + new
                x = co.np.array([words[w] for w in both], dtype=co.np.int64)
                words.frequent = [k > 0 for k in range(len(words.names))]  # all words, but no ends of pieces
                for batch in co._counted("en", words, x, len(carried), sizes, None):
                    for phrase, c in zip(batch.column("phrase").to_pylist(), batch.column("c").to_pylist(), strict=True):
                        counts[phrase] += c
                carried = both[max(0, len(both) - sizes[1] + 1) :]
            assert not whole or counts == whole
            whole = counts
    want = plain(docs, 5, 4, 2000, 100)
    for bits in (6, 8):  # a bitmap that is full or nearly so lets more through, and nothing else
        assert sorted(map(tuple, co.collocations(table(spark, docs), 5, 4, bits=bits).collect())) == want


def test_a_very_long_text_without_pieces(spark):
    docs = [("one two three " * 200_000, "en"), ("q" * 3_000_000, "en")]
    got = {r.phrase: r.c for r in co.frequent_phrases(table(spark, docs), 1000, 3).where("phrase IS NOT NULL").collect()}
    assert got == {"one": 200_000, "two": 200_000, "three": 200_000, "one two": 200_000, "two three": 200_000, "three one": 199_999, "one two three": 200_000, "two three one": 199_999, "three one two": 199_999}


def test_products_past_64_bits_and_ties(spark):
    counts = [("en", None, 9_000_000_000_000_000), ("en", "a", 8_000_000_000_000_000), ("en", "b", 7_000_000_000_000_000), ("en", "a b", 6_999_999_999_999_999), ("en", "b a", 6_999_999_999_999_999)]
    frame = spark.createDataFrame(counts, "lang string, phrase string, c long")
    original = co.frequent_phrases
    co.frequent_phrases = lambda *_: frame
    try:
        got = [tuple(r) for r in co.collocations(frame).collect()]
    finally:
        co.frequent_phrases = original
    score = 1000 * 6_999_999_999_999_999 * 9_000_000_000_000_000 // (8_000_000_000_000_000 * 7_000_000_000_000_000)
    assert sorted(got) == [("en", 1, "a b", counts[3][2], counts[1][2], counts[2][2], counts[0][2], score), ("en", 2, "b a", counts[3][2], counts[2][2], counts[1][2], counts[0][2], score)]


def test_empty(spark):
    assert co.collocations(table(spark, []).where("false")).collect() == []
    assert co.collocations(table(spark, [(None, None), ("", "en")])).collect() == []
