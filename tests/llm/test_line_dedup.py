import random

import pytest

from plumbline.llm import line_dedup
from plumbline.llm.line_dedup import line_deduplicated

SCHEMA = "doc_id long, text string, source string, gone string, line_id int"


def plain(rows, sites, chars):
    lines = {}
    order = lambda d, p: (d is not None, d or 0, p)
    for d, text, source, *_ in rows:
        for p, line in enumerate(text.split("\n") if text is not None else ()):
            k = line.strip(" \t\r")
            if len(k) >= chars:
                s, first = lines.get(k, (set(), order(d, p)))
                lines[k] = s | {source} - {None}, min(first, order(d, p))
    out = []
    for d, text, *rest in rows:
        if text is not None:
            keep = []
            for p, line in enumerate(text.split("\n")):
                s, first = lines.get(line.strip(" \t\r"), (set(), None))
                if len(s) < sites or first == order(d, p):
                    keep.append(line)
            text = "\n".join(keep)
        out.append((d, text, *rest))
    return out


@pytest.mark.parametrize(("sites", "hot"), [(2, 0.001), (3, 0.01), (9, 2.0)])
def test_matches_plain(spark, sites, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(sites)
    pool = [f"a boilerplate line number {i} é" for i in range(30)] + ["short", "", " \t padded line that repeats \r", "padded line that repeats"]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(0, 8)) + [f"own line of the document {i}"] * r.randint(0, 2)), r.choice([*"abcdefghijkl", None]), "x", 3) for i in range(120)]
    rows += [(600, pool[1] + "\n" + "a long line of text " * 50_000 + "\n" + pool[1], "z", None, None)]
    rows += [(500, None, "a", None, None), (501, "", None, None, None), (None, "own line without an id\n" + pool[0], "a", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = line_deduplicated(docs, sites=sites)
    assert got.schema == docs.schema
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, sites, 20)))
    counted = line_deduplicated(docs, sites=sites, removed="n")
    lines = lambda t: t.count("\n") + 1 if t else 0
    before = {d: t for d, t, *_ in rows}
    assert all(x.n == lines(before[x.doc_id]) - lines(x.text) or not x.text or not before[x.doc_id] for x in counted.collect())


def test_many_sites_and_empty(spark):
    rows = [(i, f"this line is on very many sites\nown text of document {i}", f"s{i}", None, None) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x.text for x in line_deduplicated(docs, sites=3000).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own text of document {i}" for i in range(1, 4000))
    got = {x.doc_id: x.text for x in line_deduplicated(docs, sites=4001).collect()}
    assert got[5] == rows[5][1]
    assert line_deduplicated(docs.limit(0)).count() == 0
