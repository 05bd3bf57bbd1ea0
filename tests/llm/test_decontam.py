import hashlib
import random
import re

import pytest

from plumbline.llm import decontam
from plumbline.llm.decontam import Automaton, contamination, decontaminated, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(doc, items):
    words = plain_words(doc)
    hit, found = set(), set()
    for name, text in items:
        w = plain_words(text)
        size = min(13, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1) if w else ():
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= {str(name)} - {"None"}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def cases():
    r = random.Random(2)
    items = [(i, " ".join(r.choices("abcd", k=r.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(25)]
    items = [(i, t if len(t.split()) > 4 else t.upper() + " zz yy") for i, t in items] + [(100, "q"), (101, "q w"), (102, "e q w"), (9, "!!"), (10, None), (11, ""), (None, "null id item"), (7, items[7][1])]
    docs = [" ".join(r.choices("abcd", k=r.randint(0, 80))) for _ in range(60)]
    docs += [f"Éa {items[k][1]}; tail{' word' * (k * 20)}" for k in range(20)] + ["e q w", "E,q.W", None, "", "...", "null ID item", "q" * 50]
    return docs, items


def test_words():
    assert [w.decode() for w in words_of("A_b-C9 É\u00a0x\x7f{y}")] == plain_words("A_b-C9 É\u00a0x\x7f{y}")


@pytest.mark.parametrize("most", [10**6, 40])
def test_matches_brute_force(spark, most, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(decontam, "AUTOMATON_WORDS", most)
    monkeypatch.setattr(decontam.marked, "__defaults__", (13, most, False))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
    for x in got.collect():
        assert tuple(x)[1:] == plain(docs[x.doc_id], items), docs[x.doc_id]


def test_short_items_in_one_state():
    a = Automaton([("1", [b"x", b"y"]), ("2", [b"w", b"x", b"y"]), ("3", [b"y"])], 13)
    mask, found = a.scan([b"w", b"x", b"y"])
    assert mask.all() and found == {"1", "2", "3"}
    mask, found = a.scan([b"v", b"x", b"y"])
    assert mask.tolist() == [False, True, True] and found == {"1", "3"}


def test_stage_keeps_clean_rows_and_columns(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, passage, "h"), (2, "x " * 400 + passage.upper() + "! y", "h"), (3, "clean", None), (None, None, None), (3, "clean", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit_words string")
    kept = decontaminated(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id IS NULL OR doc_id > 1").collect()))
    cut = {x.doc_id: x.text for x in decontaminated(docs, bench, cut=True).collect()}
    assert cut[2] == "x " * 400 + "! y" and cut[3] == "clean" and cut[None] is None
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0
