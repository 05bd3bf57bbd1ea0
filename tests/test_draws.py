import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import agreement as ag
from plumbline.plans import draws, stream


def test_units_do_not_collide(spark):
    units = spark.range(4_000_000).select(draws.unit_number(F.col("id")).alias("u"))
    assert units.distinct().agg(F.count("*"), F.max("u") < 2**60, F.min("u") >= 0).first()[:] == (4_000_000, True, True)


def test_parts_of_a_key_stay_apart(spark):
    rows = [("a:b", "c"), ("a", "b:c"), ("a:b:c", None), (None, "a:b:c"), ("", "a:b:c"), ("a:b:c", ""), (None, None), ("n", "n"), ("1:a", "n")]
    df = spark.createDataFrame(rows, "x string, y string")
    for known in (draws.unit_key, draws.unit_number):
        assert df.select(known(F.col("x"), F.col("y")).alias("u")).distinct().count() == len(rows)


@pytest.mark.parametrize(("n", "n_boot", "words"), [(100_000, 20, 1 << 16), (100_003, 3, 1 << 12), (7, 50, 64), (2, 1, 1 << 22), (1, 4, 64), (70_000, 1, 1 << 10)])
def test_drawn_as_numpy_draws(spark, monkeypatch, n, n_boot, words):
    monkeypatch.setattr(stream, "STRETCH", words)
    rng, same = np.random.default_rng(11), np.random.default_rng(11)
    for generator in (rng, same):
        generator.integers(0, 5, size=3)  # leaves half of a word behind
    got = stream.drawn(spark, n, n_boot, rng).toPandas().sort_values("number")
    want = np.stack([np.bincount(same.integers(0, n, size=n), minlength=n) for _ in range(n_boot)], axis=1)
    assert got["number"].tolist() == list(range(n))
    assert np.array_equal(np.stack([np.frombuffer(t, stream.TIMES) for t in got["times"]]), want)
    assert np.array_equal(rng.integers(0, 1000, size=9), same.integers(0, 1000, size=9))  # left where the draws end


@pytest.mark.parametrize("n", [2, 3, 1000, 2**31 + 11, 2**32 - 5, 2**32, 2**32 + 1, 2**40 + 12345, 3 * 2**61])
def test_words_of_any_range(n):
    rng = np.random.default_rng(5)
    s = stream.Stream(n, rng.bit_generator.state)
    words = np.concatenate((s.words(0, 777), s.words(777, 3000), s.words(3000, 5001)))
    found, standing = s.draws(words)
    assert np.array_equal(found[:1500].astype(np.uint64), rng.integers(0, n, size=1500, dtype=np.uint64))
    after = np.random.default_rng(0)
    after.bit_generator.state = s.after(int(np.flatnonzero(standing)[1499]) + 1)
    assert np.array_equal(after.integers(0, n, size=9, dtype=np.uint64), rng.integers(0, n, size=9, dtype=np.uint64))


def test_numbered_by_ranges(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("place"), F.col("id").cast("string").alias("unit")).repartition(6)
    rows, n = stream.numbered(df, "place")
    got = rows.orderBy("place").select("number").toPandas()["number"].tolist()
    assert n == 5000 and got == list(range(5000))


def test_equal_intervals_whatever_the_ids(spark):
    """Two of the first ids had one number once, and were drawn as one."""
    ratings = [[1, 1, 2], [2, 2, 2], [3, 3, 3], [1, 2, 1], [2, 3, 3], [3, 3, 2]]
    found = []
    for ids in ([17514, 31803, 1, 2, 3, 4], list("abcdef")):
        rows = [(str(i), f"r{k}", float(x), 10 * at + k) for at, (i, own) in enumerate(zip(ids, ratings, strict=True)) for k, x in enumerate(own)]
        df = spark.createDataFrame(rows, "item_id string, rater_id string, rating double, seq long")
        found.append([(r.ci_low, r.ci_high) for level in ag.LEVELS for r in [ag.rater_agreement(df, level, n_boot=400, seed=0, order=["seq"])]])
    assert np.allclose(found[0], found[1])


def cells(spark, n, labels):
    own = spark.range(n).select(draws.unit_number(F.col("id")).alias("unit"), F.explode(F.array(*(F.struct(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(labels)).alias("i"), F.lit(k % 2).cast("long").alias("j")) for k in range(3)))).alias("s"))
    return own.select("unit", "s.i", "s.j", F.lit(1.0).alias("x")).groupBy("unit", "i", "j").agg(F.sum("x").alias("x"))


def test_many_labels_stay_on_the_executors(spark, monkeypatch):
    rows = cells(spark, 700, 300)
    narrow = draws.label_totals(rows, 40, 3)
    monkeypatch.setattr(draws, "WIDE", 10)
    wide = draws.label_totals(rows.repartition(7), 40, 3)
    assert narrow.keys() == wide.keys() == {0, 1}
    for j in narrow:
        for a, b in zip(narrow[j], wide[j], strict=True):
            assert np.array_equal(a, b)


def test_a_million_labels(spark):
    df = spark.range(1_000_000).select(draws.unit_number(F.col("id") % 1000).alias("unit"), F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1.0).alias("x"))
    total, squares = draws.label_totals(df, 5, 1)[0]
    assert np.array_equal(total % 1000, np.zeros(5)) and (squares >= total).all() and total == pytest.approx(np.full(5, 1e6), rel=0.15)


@pytest.mark.parametrize("order", [[], ["seq"]])
@pytest.mark.parametrize("level", ["nominal", "ordinal"])
def test_alpha_of_a_wide_scale_is_that_of_a_narrow_one(spark, monkeypatch, level, order):
    rng = np.random.default_rng(2)
    rows = [(f"i{i}", f"r{k}", float(rng.integers(0, 40)), 3 * i + k) for i in range(60) for k in range(3)]
    df = spark.createDataFrame(rows, "item_id string, rater_id string, rating double, seq long")
    narrow = ag.alpha_draws(df, level, 30, 5, order)
    monkeypatch.setattr(draws, "WIDE", 8)
    monkeypatch.setattr(ag, "WIDE", 8)
    assert ag.alpha_draws(df.repartition(5), level, 30, 5, order) == pytest.approx(narrow, rel=1e-9)


def alpha_of(rows, level):
    """Krippendorff's alpha from all pairs, or None."""
    items = {}
    for i, _, x in rows:
        items.setdefault(i, []).append(x)
    items = {i: v for i, v in items.items() if len(v) > 1}
    every = [x for v in items.values() for x in v]
    n = len(every)
    if len(items) < 2:
        return None
    counts = {v: every.count(v) for v in set(every)}
    mid = {v: sum(c for u, c in counts.items() if u < v) + counts[v] / 2 for v in counts}
    distance = {"nominal": lambda a, b: float(a != b), "interval": lambda a, b: (a - b) ** 2, "ordinal": lambda a, b: (mid[a] - mid[b]) ** 2}[level]
    chance = sum(counts[a] * counts[b] * distance(a, b) for a in counts for b in counts)
    if not chance:
        return None
    return 1 - (n - 1) * sum(distance(a, b) / (len(v) - 1) for v in items.values() for a in v for b in v) / chance


@pytest.mark.parametrize("paired", [1024, 2])
@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
def test_leaving_a_rater_out_is_alpha_without_the_rater(spark, monkeypatch, level, paired):
    monkeypatch.setattr(ag, "PAIRED", paired)
    rng = np.random.default_rng(9)
    rows = [(f"i{i}", f"r{k}", float(rng.integers(1, 6))) for i in range(30) for k in range(7) if rng.random() < 0.5]
    rows += [("alone", "lone", 3.0), ("two", "r0", 1.0), ("two", "r1", 1.0), ("both", "r0", 1.0), ("both", "lone2", 9.0)]
    got = {r.rater_id: r for r in ag.rater_dropout(spark.createDataFrame(rows, "item_id string, rater_id string, rating double"), level).collect()}
    assert set(got) == {k for _, k, _ in rows}
    whole = alpha_of(rows, level)
    for rater, r in got.items():
        without = alpha_of([x for x in rows if x[1] != rater], level)
        assert r.note == "" and r.alpha_without == pytest.approx(without) and r.delta == pytest.approx(without - whole, abs=1e-9)
        assert r.n_ratings == sum(x[1] == rater for x in rows)


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
def test_an_item_of_many_raters_makes_no_pairs_of_them(spark, level):
    rows = spark.range(20_000).select((F.col("id") % 2 * F.col("id") % 5).cast("string").alias("item_id"), F.concat(F.lit("r"), F.floor(F.col("id") / 2)).alias("rater_id"), (F.col("id") % 7 % 3).cast("double").alias("rating"))
    plan = ag.rater_dropout(rows, level)
    found = plan.agg(F.count("*"), F.sum("n_ratings"), F.count("alpha_without")).first()
    assert tuple(found) == (10_000, 20_000, 10_000)
    text = plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("n", [1, 7, 8, 500, 3001])
def test_blocks_draw_as_one_resample_at_a_time(n):
    units = np.random.default_rng(n).integers(0, 2**60, n)
    units[:4] = [0, 2**60 - 1, draws.PRIME, 2**30 - 1][:n]
    coefficients = draws.polynomials(3, 0, 203)
    coefficients[:3] = [[0] * 5, [draws.PRIME - 1] * 5, [draws.THRESHOLDS[0], 0, 0, 0, 0]]
    firsts, blocks = zip(*draws.poisson_blocks(units, coefficients), strict=True)
    assert firsts[0] == 0 and np.array_equal(np.concatenate(blocks), np.stack([draws.poisson(units, None, c) for c in coefficients]))


def test_any_bin_has_one_multiplicity_or_is_told_apart():
    for k, times in enumerate(draws._TIMES.tolist()):
        ends = [int(k * draws.PRIME / draws.BINS) + x for x in (-3, 0, 3)] + [int((k + 1) * draws.PRIME / draws.BINS) + x for x in (-3, 0, 3)]
        assert times == draws.EXACT or {int(np.searchsorted(draws.THRESHOLDS, t % draws.PRIME, side="right")) for t in ends} == {times}


def test_keyed_means_are_dealt_out_whatever_their_number(spark, monkeypatch):
    """Rows past SMALL once stayed in the partitions they came in, here one."""
    monkeypatch.setattr(draws, "SMALL", 100)
    rows, parts = spark.range(1000).coalesce(1).selectExpr("id item_id", "double(id % 7) x"), []
    blocks = draws._blocks
    monkeypatch.setattr(draws, "_blocks", lambda cells, *more: parts.append(cells.rdd.getNumPartitions()) or blocks(cells, *more))
    means = draws.resampled_means(rows, F.col("x"), ["item_id"], [], 50, 1)
    assert parts == [10] and len(means) == 50 and abs(means.mean() - 3) < 0.2
