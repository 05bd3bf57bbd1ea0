"""Evaluation data derived from the star schema, so that every operator has a table of any size to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_parquet


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item = user, rater = event number mod 5, rating = last event's type; rating_num from its value."""
    e = read_parquet(spark, f"{sf_dir}/events.parquet", ["user_id", "event_id", "event_type", "value"])
    rater = F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string"))
    number = 1 + F.floor("value").cast("int") % 5
    return e.groupBy(F.col("user_id").alias("item_id"), rater.alias("rater_id")).agg(F.max_by("event_type", "event_id").alias("rating"), F.max_by(number, "event_id").alias("rating_num"))


def numeric(rows: DataFrame) -> DataFrame:
    return rows.select("item_id", "rater_id", F.col("rating_num").cast("double").alias("rating"))


def sparse_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings with gaps: who only looked has not rated."""
    return ratings(spark, sf_dir).where("rating <> 'view'")


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of one user compare their types; the higher value wins, near-equal ones tie."""
    e = read_parquet(spark, f"{sf_dir}/events.parquet", ["user_id", "event_id", "event_type", "value", "ts"])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select("event_id", F.col("user_id").alias("item_id"), F.col("event_type").alias("model_a"), F.col("value").alias("va"), F.lead("event_type").over(w).alias("model_b"), F.lead("value").over(w).alias("vb"))
    winner = F.when(F.abs(F.col("va") - F.col("vb")) < 1, "tie").when(F.col("va") > F.col("vb"), F.col("model_a")).otherwise(F.col("model_b"))
    rows = rows.where(F.col("model_b").isNotNull() & (F.col("model_a") != F.col("model_b")))
    return rows.select(F.col("event_id").alias("pair_id"), F.col("event_id").alias("seq"), "item_id", "model_a", "model_b", winner.alias("winner"))


def positions(spark: SparkSession, sf_dir: str, pair: str) -> DataFrame:
    return leaderboard(spark, sf_dir).select(F.col(pair).alias("pair_id"), "seq", F.col("model_a").alias("option_a"), F.col("model_b").alias("option_b"), F.nullif(F.col("winner"), F.lit("tie")).alias("winner"))


def paired_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_returnflag", "l_discount", "l_tax"])
    return line.groupBy(F.col("l_orderkey").alias("item_id")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("a"),
        F.max(F.when(F.col("l_discount") >= 0.07, 1).otherwise(0)).alias("b"),
        F.max("l_tax").alias("a_cont"),
        F.max("l_discount").alias("b_cont"),
    )


def continuous(pairs: DataFrame) -> DataFrame:
    return pairs.select("item_id", F.col("a_cont").cast("double").alias("a"), F.col("b_cont").cast("double").alias("b"))


def independent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_parquet(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"])
    rows = o.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return rows.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("score"), F.col("o_totalprice").cast("double").alias("score_cont"))


def judge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_parquet(spark, f"{sf_dir}/labels.parquet", ["doc_id", "quality"])
    docs = read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "n_chars"])
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("human"), F.when(F.col("n_chars") >= 200, 1).otherwise(0).alias("judge"), F.col("lang").alias("slice"))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).select("item_id", (F.col("item_id") % 25).alias("cluster_id"), "rater_id", "rating")


def baseline_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_parquet(spark, f"{sf_dir}/events.parquet", ["user_id", "event_id", "event_type"])
    return e.groupBy(F.col("user_id").alias("item_id")).agg(F.min_by("event_type", "event_id").alias("judge"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next."""
    docs = read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "n_chars"])
    labels = read_parquet(spark, f"{sf_dir}/labels.parquet", ["doc_id", "quality", "toxic"])
    one = docs.join(labels, "doc_id")
    two = one.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n_chars").alias("n2"), F.col("quality").alias("q2"), F.col("toxic").alias("t2"))
    return one.join(two, "doc_id").select(F.col("doc_id").alias("pair_id"), F.when(F.col("quality") >= F.col("q2"), 1).otherwise(0).alias("preference"), F.col("n_chars").alias("len_a"), F.col("n2").alias("len_b"), F.when(F.col("toxic") <= F.col("t2"), 1).otherwise(0).alias("human_preference"))
