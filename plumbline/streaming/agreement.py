"""Running agreement over a stream of ratings.

Every statistic here is a function of counts that add, so a stream needs no operator of its own: counts by item and
rating are a streaming aggregate, and alpha is computed from them whenever they have changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.agreement import expected, unit_stats


def running_counts(stream: DataFrame) -> DataFrame:
    """(item_id, rating, c) of a streaming frame of ratings."""
    return stream.where(F.col("rating").isNotNull()).groupBy("item_id", "rating").agg(F.count("*").alias("c"))


def alpha_of_counts(counts: DataFrame, level: str = "nominal") -> DataFrame:
    """alpha, n_units, n_ratings from (item_id, rating, c)."""
    many = counts.groupBy("item_id").agg(F.sum("c").alias("m")).where("m >= 2")
    kept = counts.join(many, "item_id")
    units = unit_stats(kept, level).agg(F.sum("o").alias("o"), F.count("*").alias("n_units"))
    alpha = F.when(F.col("n_units") >= 2, 1 - (F.col("n") - 1) * F.col("o") / F.nullif(F.col("e"), F.lit(0.0)))
    return units.crossJoin(expected(kept, level)).select(alpha.alias("alpha"), "n_units", F.col("n").cast("long").alias("n_ratings"))


def follow_alpha(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, level: str = "nominal") -> StreamingQuery:
    """Calls sink(alpha, batch) after each batch of new ratings; the counts are the query's state."""
    return running_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda counts, batch: sink(alpha_of_counts(counts, level), batch)).start()
