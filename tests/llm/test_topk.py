import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk
from plumbline.llm.topk import Block, top_k, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def plain(rows, is_query, k=10):
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i is not None and is_query(i)}):
        x = min(v for i, v in whole if i == q)
        found = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in whole if i is not None and i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return out


def rows_of(seed, n, clusters):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, 12))
    return [(int(i), (centres[i % clusters] + r.standard_normal(12) * 0.4).astype(np.float32).tolist(), 1, "x") for i in range(n)]


@pytest.mark.parametrize(("block", "queries"), [(8192, 2048), (64, 3)])
def test_matches_brute_force(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rows = rows_of(1, 700, 5) + [(1000 + i, [0.25] * 12, 2, None) for i in range(300)] + rows_of(1, 700, 5)[300:320]
    rows += [(None, [1.0] * 12, 0, ""), (2000, None, 0, ""), (2100, [], 0, ""), (2200, [1.0, None] * 6, 0, ""), (2300, [float("nan")] * 12, 0, ""), (2400, [float("inf")] * 12, 0, ""), (2500, [0.5, -3.0], 0, "")]
    frame = vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = top_k(frame, frame.where(F.col("id") % 100 == 0))
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 100 == 0)


def test_few_rows_and_none(spark):
    rows = rows_of(2, 4, 2)
    frame = vectors(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, top_k(frame, frame).collect())) == plain(rows, lambda i: True)
    assert top_k(frame, frame.limit(0)).count() == 0 and top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_a_block_stops_early_on_proof():
    r = np.random.default_rng(3)
    centres = r.standard_normal((20, 64))
    x = centres[np.arange(4000) % 20] + r.standard_normal((4000, 64)) * 0.3
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    block, looked = Block(np.arange(4000), x), []
    inner = block._with
    block._with = lambda best, which, *a: looked.append(len(which)) or inner(best, which, *a)
    for own in range(0, 4000, 500):
        got = block.search(x[own], own, [], 10)
        scores = x @ x[own]
        want = sorted((-int(scores[i]), i) for i in range(4000) if i != own)[:10]
        assert got == want
    assert max(looked) <= 32 + 4000 // 8


def test_large_ties_keep_smallest_ids(spark):
    r = random.Random(1)
    ids = r.sample(range(5000), 3000)
    rows = [(i, [1.0, 0.0], 0, "") for i in ids] + [(9000, [1.0, 1.0], 0, "")]
    frame = vectors(spark.createDataFrame(rows, SCHEMA).repartition(2))
    got = top_k(frame, frame.where("id = 9000")).orderBy("rank").collect()
    assert [x.vec_id for x in got] == sorted(ids)[:10]
