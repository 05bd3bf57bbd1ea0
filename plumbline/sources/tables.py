"""Reading and writing: Parquet with only the columns asked for, and CSV that keeps every string as it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: How CSV tells a missing value from an empty string.
NULL = "\\N"


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, nullValue=NULL, escape='"')


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strings such as NA stay strings."""
    return spark.read.csv(path, schema=schema, header=True, nullValue=NULL, escape='"', multiLine=True)
