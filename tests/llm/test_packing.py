import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm.packing import Encoder, Packer, hilbert, packed, projected, stretch_of, stretches
from plumbline.llm.queries import byte_pairs


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_hilbert_is_a_bijection_of_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    keys = hilbert(points, bits=3)
    assert sorted(keys) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_both_libraries_agree(plain):
    encode = Encoder(**{"path": byte_pairs()["tokenizer"], "ranks": byte_pairs()["ranks"], "pattern": byte_pairs()["pattern"]})
    chars = [chr(c) for c in range(0x250)]
    r = random.Random(1)
    texts = ["", " ", "\r\n\t x  \n\n y ", "it's I'LL", "<|endoftext|> a<|endoftext|>", "日本語 ١٢ 🙂", "a" * 5000, " " * 3000]
    texts += chars + [f"a{c}b {c}{c} {c}1" for c in chars] + ["".join(r.choices(chars, k=60)) for _ in range(300)]
    texts += ["".join(r.choices("aéIl' \n\t.,1²ß­", k=40)) for _ in range(300)]
    for t in texts:
        assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_packer_fills_and_ends_in_powers_of_two():
    r = random.Random(2)
    docs = [(i, np.array(r.choices(range(9), k=r.choice([1, 2, 15, 16, 17, 100])), np.uint32)) for i in range(50)]
    packer = Packer(16, 7)
    pieces = [p for d in docs for p in packer.take(*d)] + list(packer.end())
    check([(d, s, len(i), i, t, q, o) for d, s, i, t, q, o in pieces], dict(docs), 16)


def check(pieces, ids, length):
    for d, group in itertools.groupby(sorted(pieces, key=lambda p: p[:2]), key=lambda p: p[0]):
        group = list(group)
        assert np.concatenate([p[3] for p in group]).tolist() == ids[d].tolist()
        assert [p[1] for p in group] == [0, *itertools.accumulate(p[2] for p in group)][:-1]
        assert {p[4] for p in group} == {len(ids[d])}
    assert {p[0] for p in pieces} == set(ids)
    sizes = []
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: p[5:]), key=lambda p: p[5]):
        group = list(group)
        assert [p[6] for p in group] == [0, *itertools.accumulate(p[2] for p in group)][:-1]
        sizes.append(sum(p[2] for p in group))
    assert all(s <= length and s & (s - 1) == 0 for s in sizes)
    return sizes


def test_round_trip_on_documents(spark, plain):
    r = random.Random(3)
    texts = [" ".join(r.choices(["alpha", "béta", "Gamma.", "\n", "x1"], k=r.choice([0, 1, 40, 3000]))) for _ in range(60)] + [None, "", "same"] + ["same copy"] * 80
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int")
    got = packed(docs, **byte_pairs())
    rows = [(x.doc_id, x.start, x.length, np.frombuffer(x.ids, "<u4"), x.doc_tokens, x.sequence_id, x.offset) for x in got.collect()]
    check(rows, {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in enumerate(texts)}, 2048)
    from plumbline.llm.packing import digests

    assert all(x.ids_crc32 == zlib.crc32(bytes(x.ids)) for x in digests(got, "ids").collect())
    assert packed(docs.limit(0), **byte_pairs()).count() == 0
    repeated = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    assert sum(x.length for x in packed(repeated, **byte_pairs()).collect()) == sum(len(plain.encode(t).ids) + 1 for t in ("a b", "a b", "c", "c"))


def test_copies_project_alike_and_long_texts_in_blocks(monkeypatch):
    matrix = np.random.default_rng(11).standard_normal((1024, 4))
    text = "lorem ipsum " * 50
    whole = projected(text, matrix)
    monkeypatch.setattr("plumbline.llm.packing.BLOCK", 37)
    assert np.allclose(projected(text, matrix), whole) and np.allclose(projected(None, matrix), 0)


def test_stretches_have_equal_bytes(spark):
    r = random.Random(4)
    long_ = [(i, "".join(r.choices("qxz", k=20_000))) for i in range(40)]  # all of one kind, so near each other
    copies = [(100 + i, "one text that many have " * 20) for i in range(2000)]
    short = [(5000 + i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "no", "yes"], k=60))) for i in range(2000)]
    docs = spark.createDataFrame(long_ + copies + short, "doc_id long, text string").repartition(7)
    got = stretches(docs).select("doc_id", "text", "key", "stretch").rdd.glom().collect()  # a small table
    assert sorted((x.doc_id, x.text) for part in got for x in part) == sorted(long_ + copies + short)
    sizes = [sum(len(x.text) for x in part) for part in got]
    assert len(got) == 8 and max(sizes) < 1.8 * sum(sizes) / 8
    rows = [(x.key, x.doc_id) for part in got for x in part]
    assert rows == sorted(rows)


def test_stretch_of_rows():
    keys, ids = np.array([3, 5, 5, 9]), np.array([7, 10, 20, 1])
    rows = [(k, i) for k in range(11) for i in (-1, 1, 7, 10, 15, 20, 21)]
    got = stretch_of(np.array([k for k, _ in rows]), np.array([i for _, i in rows]), keys, ids)
    cuts = list(zip(keys.tolist(), ids.tolist(), strict=True))
    for (k, i), place in zip(rows, got.tolist(), strict=True):
        assert place == sum(c <= (k, i) for c in cuts)
    assert stretch_of(np.array([1]), np.array([1]), keys[:0], ids[:0]).tolist() == [0]
