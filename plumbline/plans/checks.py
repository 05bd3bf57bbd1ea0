"""Validation: each check is one aggregate over the input, and a refusal that names what it found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def need_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks the column(s) {', '.join(missing)}; it needs {', '.join(columns)}")


def need_confidence(confidence: float) -> None:
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must lie strictly between 0 and 1, not {confidence}")


def need_choice(name: str, value: object, choices: Sequence[object]) -> None:
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(map(repr, choices))}, not {value!r}")


def need_resamples(n_boot: int, least: int = 1) -> None:
    if n_boot < least:
        raise ValueError(f"n_boot must be at least {least}, not {n_boot}")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_counts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Aggregates, for a scan that other figures share: rows, those without finite scores, and the first item of these."""
    bad = ~F.expr("true")
    for c in columns:
        bad = bad | ~finite(F.col(c).cast("double"))
    item = F.col("item_id") if "item_id" in df.columns else F.lit(None)
    return [F.count("*"), F.count_if(bad), F.min(F.when(bad, item))]


def need_finite(df: DataFrame, columns: Sequence[str], what: str) -> int:
    """The number of rows; refuses none and scores that aren't finite, naming the first item that has one."""
    return need_scores(*df.agg(*finite_counts(df, columns)).first(), what)


def need_scores(n: int, odd: int, first: object, what: str) -> int:
    if not n:
        raise ValueError(f"{what} must not be empty")
    if odd:
        raise ValueError(f"{what} has {odd} of {n} rows without a finite score{'' if first is None else f', the first item {first!r}'}; drop or fill them first")
    return n


def need_ids(df: DataFrame, columns: Sequence[str], what: str) -> None:
    need_none(columns, df.agg(*null_counts(columns)).first(), what)


def null_counts(columns: Sequence[str]) -> list[Column]:
    """Aggregates, for a scan that other figures share: how many rows lack each column."""
    return [F.count_if(F.col(c).isNull()) for c in columns]


def need_none(columns: Sequence[str], counts: Sequence[int], what: str) -> None:
    for c, n in zip(columns, counts, strict=True):
        if n:
            raise ValueError(f"{what} has {n} row(s) whose {c} is missing")


def need_unique(df: DataFrame, keys: Sequence[str], why: str) -> None:
    again = df.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(1).collect()  # the first by key
    if again:
        found = ", ".join(f"{k}={again[0][k]!r}" for k in keys)
        raise ValueError(f"{found} occurs {again[0]['count']} times; {why}")


def need_one_per(df: DataFrame, key: str, value: str, what: str) -> None:
    mixed = df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1").orderBy(key).limit(1).collect()
    if mixed:
        raise ValueError(f"{what}: {key}={mixed[0][key]!r} has {mixed[0].n} different values of {value}")


def is_binary(c: Column) -> Column:
    """An aggregate: whether all values are 0 or 1."""
    return F.coalesce(F.bool_and(c.isin(0, 1)), F.lit(False))


def tidy(c: Column) -> Column:
    """Without white space of any kind at both ends, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)^\s+", ""), r"(?U)\s+$", ""))


def is_tie(c: Column) -> Column:
    """Whether a winner is spelled as a tie; null is none here."""
    return F.coalesce(tidy(c) == "tie", F.lit(False))
