"""A corpus pipeline over documents: each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import remainder, table, written
from plumbline.llm.decontam import decontaminated
from plumbline.llm.langid import fitted, in_known_language
from plumbline.llm.line_dedup import line_deduplicated
from plumbline.llm.packing import digests, packed
from plumbline.llm.queries import byte_pairs, pieces_path
from plumbline.llm.simhash import near_deduplicated


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no one language accounts for, go."""
    return in_known_language(docs, fitted(docs.where(remainder(F.col("doc_id"), 5) != 0), pieces_path()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three sites or more stay where they come first only; every document stays."""
    return line_deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return near_deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go, and from the others the benchmark's spans."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), cut=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences with their ids."""
    pieces = packed(docs, **byte_pairs())
    return digests(pieces, "ids")


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The first stages learn a model and hash words, which SQL can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
