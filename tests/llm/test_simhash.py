import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from plumbline.llm import common
from plumbline.llm.simhash import fingerprint, links, near_deduplicated, simhash_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints):
    """Of (doc_id, print): the smallest id that each id reaches."""
    low = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for d, p in prints:
            least = min(low[e] for e, q in prints if (p ^ q).bit_count() <= 2 or d == e)
            if least < low[d]:
                low[d], changed = least, True
    return low


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "É é É a b", "a\x0bb\x0cc\x00d\x1fe f", "x y z " * 50, "a\u00a0b c\u2003d e f g"])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_long_text_is_hashed_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bb", "Ccc", "d" * 90], k=500))
    monkeypatch.setattr(common, "BLOCK", 64)
    assert fingerprint(text) == plain_fingerprint(text)


def test_components_match_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices("abcdefghij", k=r.choice([0, 1, 2, 3, 5, 40, 60]))) for _ in range(150)]
    texts += [t + " tail" for t in texts[:40]] + texts[:30] + ["one", "ONE", None, "", " "]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert {d: x.component_id for d, x in got.items()} == want
    assert all(got[d].fingerprint == f"{plain_fingerprint(t):016x}" for d, t in rows)
    assert len(set(want.values())) < len(want) - 30


@pytest.mark.parametrize("tile_rows", [4096, 3])
def test_links_lose_none_in_dense_balls(spark, tile_rows):
    r = np.random.default_rng(5)
    prints = set()
    for c in r.integers(0, 2**63, 6, dtype=np.uint64).tolist():
        for _ in range(60):
            x = c
            for b in r.integers(0, 64, r.integers(0, 5)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints) + [0, 2**64 - 1]
    rows = [(x - 2**64 if x >= 2**63 else x, i) for i, x in enumerate(prints)]
    got = links(spark.createDataFrame(rows, "print long, node long"), tile_rows=tile_rows).collect()
    assert all((prints[e.a] ^ prints[e.b]).bit_count() for e in got)

    def closure(pairs):
        low = list(range(len(prints)))
        for _ in range(len(prints)):
            before = list(low)
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
            if before == low:
                return low

    want = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert closure([(e.a, e.b) for e in got]) == closure(want)


def test_nulls_repeats_extra_columns_and_empty(spark):
    schema = T.StructType([*T._parse_datatype_string(DOCS).fields, T.StructField("print", T.StringType()), T.StructField("component_id", T.LongType())])
    rows = [(1, "a b c d", None, None, None, "x", 9), (1, "a b c d", "en", "s", 7, None, None), (None, "a b c d", "en", "s", 7, None, None), (2, None, None, None, None, None, None), (3, "", None, None, None, None, None), (4, "w " * 9, "en", None, 1, "p", 1)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((x.doc_id, x.component_id) for x in simhash_components(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, None), (2, 2), (3, 2), (4, 4)], key=str)
    kept = near_deduplicated(docs)
    assert kept.schema == docs.schema
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["1", "2", "4", "None"]
    none = docs.limit(0)
    assert simhash_components(none).count() == 0 and near_deduplicated(none).count() == 0


def test_texts_of_one_id_share_a_component(spark):
    a, b, c = "alpha beta gamma delta", "one two three four five", "x y z"
    docs = spark.createDataFrame([(5, a, "p"), (5, b, "q"), (1, a, "r"), (2, b, "s"), (7, c, "t"), (7, c, "k"), (7, c + " w", "a"), (9, None, None)], "doc_id long, text string, TEXT_two string")
    got = {(x.doc_id, x.component_id) for x in simhash_components(docs).collect()}
    assert got == {(5, 1), (1, 1), (2, 1), (7, 7), (9, 9)}
    assert sorted(tuple(x) for x in near_deduplicated(docs).collect()) == [(1, a, "r"), (7, c, "k"), (9, None, None)]


def test_no_machine_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = {}, Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
