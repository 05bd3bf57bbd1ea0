"""Frames from sequences in memory, numbered in their order, for callers who have no table yet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _frame(spark: SparkSession, columns: Mapping[str, Sequence], schema: str) -> DataFrame:
    sizes = {len(c) for c in columns.values()}
    if len(sizes) > 1:
        raise ValueError(f"the sequences must be of one length, not {sorted(sizes)}")
    rows = [(k, *(None if _missing(x) else x for x in row)) for k, row in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, schema)


def _missing(x: object) -> bool:
    return x is None or x is pd.NA or (isinstance(x, float) and x != x)


def scores(spark: SparkSession, values: Sequence[float]) -> DataFrame:
    """(item_id, score)"""
    return _frame(spark, {"score": [float(x) for x in values]}, "item_id long, score double")


def paired(spark: SparkSession, a: Sequence[float], b: Sequence[float]) -> DataFrame:
    """(item_id, a, b)"""
    return _frame(spark, {"a": [float(x) for x in a], "b": [float(x) for x in b]}, "item_id long, a double, b double")


def systems(spark: SparkSession, by_name: Mapping[str, Sequence[float]]) -> DataFrame:
    """(system, item_id, score); pass list(by_name) to audit() as systems to keep their order."""
    rows = [(name, k, float(x)) for name, values in by_name.items() for k, x in enumerate(values)]
    return spark.createDataFrame(rows, "system string, item_id long, score double")


def labels(spark: SparkSession, human: Sequence, judge: Sequence, slices: Sequence | None = None) -> DataFrame:
    """(item_id, human, judge, slice if there are any), as text."""
    text = lambda values: [None if _missing(x) else str(x) for x in values]
    columns = {"human": text(human), "judge": text(judge)} | ({"slice": text(slices)} if slices is not None else {})
    return _frame(spark, columns, "item_id long, " + ", ".join(f"{c} string" for c in columns))


def preferences(spark: SparkSession, chosen: Sequence, lengths: Sequence[Sequence[float]], human: Sequence | None = None) -> DataFrame:
    """(pair_id, preference, len_a, len_b, human_preference if there is one)"""
    columns = {"preference": [str(x) for x in chosen], "len_a": [float(x[0]) for x in lengths], "len_b": [float(x[1]) for x in lengths]}
    columns |= {"human_preference": [str(x) for x in human]} if human is not None else {}
    kinds = {"preference": "string", "len_a": "double", "len_b": "double", "human_preference": "string"}
    return _frame(spark, columns, "pair_id long, " + ", ".join(f"{c} {kinds[c]}" for c in columns))
