import pytest

from plumbline.operators import relational as rel
from plumbline.operators.agreement import alphas
from plumbline.sources.tables import read_csv, read_parquet, write_csv
from plumbline.streaming.agreement import follow_alpha

RATINGS = "item_id long, rater_id long, rating string"


def test_csv_keeps_strings(spark, tmp_path):
    rows = [(1, "NA"), (2, ""), (3, None), (4, 'quote " and, comma'), (5, "two\nlines")]
    df = spark.createDataFrame(rows, "id long, text string")
    write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "t"), "id long, text string").collect())) == rows


def test_parquet_reads_only_columns_asked_for(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 2 AS x").write.parquet(str(tmp_path / "p"))
    df = read_parquet(spark, str(tmp_path / "p"), ["x"])
    assert df.columns == ["x"] and "ReadSchema: struct<x:bigint>" in df._jdf.queryExecution().toString()


def test_alpha_follows_a_stream(spark, tmp_path):
    rows = [(i, k, "ab"[(i + k * (i % 5 == 0)) % 2]) for i in range(30) for k in range(3)]
    whole = spark.createDataFrame(rows, RATINGS)
    for part in (0, 1):
        whole.where(f"item_id % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(RATINGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = follow_alpha(stream, lambda df, batch: seen.append(df.first()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert len(seen) >= 2 and seen[-1].alpha == pytest.approx(alphas(whole).first().alpha)


def test_joins_check_keys(spark):
    many, one = spark.createDataFrame([(1, 2), (1, 3)], "k int, x int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, y int")
    with pytest.raises(ValueError, match="one row a key"):
        rel.join_one(many, one, ["k"])
    assert rel.join_one(many, one.limit(1), ["k"]).count() == 2


def test_frames_from_sequences(spark):
    import plumbline
    from plumbline.sources import frames

    assert plumbline.score_ci(frames.scores(spark, [1, 0, 1, 1])).estimate == 0.75
    assert plumbline.compare_paired(frames.paired(spark, [1, 1, 0], [0, 1, 0])).n_discordant == 1
    found = plumbline.judge_validation(frames.labels(spark, [1, 0, None, 1], [1, 0, 1, 0], ["x", "x", "y", "y"]), n_boot=0)
    assert (found.n_items, found.n_dropped, found.accuracy) == (3, 1, pytest.approx(2 / 3)) and found.worst_slice == "x"
    bias = plumbline.length_bias(frames.preferences(spark, ["A", "B", "A"], [(5, 1), (2, 9), (1, 4)]))
    assert bias.longer_rate == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="one length"):
        frames.paired(spark, [1], [1, 2])
    report = plumbline.audit(scores=frames.systems(spark, {"new": [1, 1, 0, 1], "old": [0, 1, 0, 1]}), systems=["new", "old"])
    assert report.worst_severity == "critical" and report.severity_counts["info"] >= 2
