"""Numpy's stream of bounded whole numbers, made by tasks: resamples of n units as `default_rng(seed).integers(0, n)` draws
them, number by number, without a list of units or draws anywhere.

The generator can be advanced to any place, so each task makes a stretch of its words. A word whose product with n has a
small lower half is rejected (Lemire's method), which moves all later draws; words that stand are therefore counted by
stretch first, a row a stretch, and a stretch then knows the number of its first draw. Draws are dealt out by ranges of
units, where they become each unit's multiplicities in all resamples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a stretch (an even number), and multiplicities that a task makes at once.
STRETCH, DRAWS = 1 << 22, 4_000_000
#: A multiplicity in one resample; its mean is one.
TIMES = np.uint16
LOW = np.uint64(0xFFFFFFFF)


def numbered(df: DataFrame, by: str) -> tuple[DataFrame, int]:
    """df with `number` from 0 in order of a column, and how many rows there are; equal ones in order of `unit`.

    Ranges of rows are numbered on their own and then moved by the sizes of the ranges before, a row a range.
    """
    ranged = df.repartitionByRange(by, "unit").withColumn("range_no", F.spark_partition_id()).persist()  # one choice of ranges
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("range_no").agg(F.count("*").alias("range_n"))
    n = sizes.agg(F.sum("range_n")).first()[0] or 0
    moved = sizes.select("range_no", F.coalesce(F.sum("range_n").over(before), F.lit(0)).alias("moved"))
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(by, "unit"))
    out = ranged.withColumn("inside", inside).join(F.broadcast(moved), "range_no")  # a row a range
    return out.withColumn("number", F.col("inside") - 1 + F.col("moved")).drop("range_no", "inside", "moved"), n


class Stream:
    """Where a generator's words begin: those of 32 bits for up to 2**32 units, halves of the generator's own, else of 64."""

    def __init__(self, n: int, state: dict):
        self.n, self.state, self.narrow = n, state, n <= 1 << 32

    def words(self, first: int, last: int) -> np.ndarray:
        """Words from first to before last. A half that the generator has kept from before is its first word."""
        kept = self.narrow and self.state["has_uint32"]
        if kept and first == 0:
            return np.concatenate((np.array([self.state["uinteger"]], np.uint64), self._made(0, last - 1)))
        return self._made(first - bool(kept), last - bool(kept))

    def _made(self, first: int, last: int) -> np.ndarray:
        if last <= first:
            return np.zeros(0, np.uint64)
        made = np.random.PCG64()
        made.state = self.state | {"has_uint32": 0, "uinteger": 0}
        size = 2 if self.narrow else 1
        begin = first // size
        made.advance(begin)
        raw = made.random_raw(-(-last // size) - begin)
        if not self.narrow:
            return raw
        halves = np.stack((raw & LOW, raw >> np.uint64(32)), axis=1).ravel()
        return halves[first - 2 * begin : last - 2 * begin]

    def draws(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The draws of words, and which of the words stand."""
        n = np.uint64(self.n)
        if self.narrow:
            product = words * n
            stand = (product & LOW) >= np.uint64((1 << 32) % self.n)
            return (product >> np.uint64(32))[stand].astype(np.int64), stand
        low, high = words & LOW, words >> np.uint64(32)
        n0, n1 = n & LOW, n >> np.uint64(32)
        mid = high * n0 + (low * n0 >> np.uint64(32))
        mid2 = low * n1 + (mid & LOW)
        stand = words * n >= np.uint64((1 << 64) % self.n)
        return (high * n1 + (mid >> np.uint64(32)) + (mid2 >> np.uint64(32)))[stand].astype(np.int64), stand

    def after(self, words: int) -> dict:
        """The generator's state when so many words are used."""
        kept = bool(self.narrow and self.state["has_uint32"])
        made = np.random.PCG64()
        made.state = self.state | {"has_uint32": 0, "uinteger": 0}
        used = max(words - kept, 0)
        if not self.narrow:
            made.advance(used)
            return made.state | {k: self.state[k] for k in ("has_uint32", "uinteger")}
        if kept and not words:
            return self.state
        made.advance(used // 2)
        if used % 2:
            half = int(made.random_raw()) >> 32
            return made.state | {"has_uint32": 1, "uinteger": half}
        return made.state


def _standing(streams: dict[int, Stream]):  # noqa: ANN202
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [int(streams[g].draws(streams[g].words(k * STRETCH, (k + 1) * STRETCH))[1].sum()) for g, k in zip(part["g"].tolist(), part["k"].tolist(), strict=True)]
            yield part.assign(n=found)

    return counts


def _dealt(streams: dict[int, Stream], first_of: dict[int, list[int]], n_boot: int, width: int):  # noqa: ANN202
    """Stretches to (group, range of units, resample, places in the range)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for g, k in zip(part["g"].tolist(), part["k"].tolist(), strict=True):
                n, first = streams[g].n, first_of[g][k]
                if not k:  # ranges without a draw have units all the same
                    yield pd.DataFrame({"g": g, "own": np.arange(-(-n // width)), "b": 0, "places": b""})
                values = streams[g].draws(streams[g].words(k * STRETCH, (k + 1) * STRETCH))[0][: max(0, n * n_boot - first)]
                resample, own = (first + np.arange(len(values))) // n, values // width
                order = np.lexsort((resample, own))
                keys = np.stack((own[order], resample[order]), axis=1)
                begins = np.flatnonzero(np.diff(keys, axis=0, prepend=-1).any(axis=1))
                places = (values % width)[order].astype(np.uint16)
                ends = [*begins[1:].tolist(), len(places)]
                yield pd.DataFrame({"g": g, "own": keys[begins, 0], "b": keys[begins, 1], "places": [places[a:z].tobytes() for a, z in zip(begins.tolist(), ends, strict=True)]})

    return rows


def _counted(sizes: dict[int, int], n_boot: int, width: int):  # noqa: ANN202
    def group(part: pd.DataFrame) -> pd.DataFrame:
        g, own = int(part["g"].iloc[0]), int(part["own"].iloc[0])
        times = np.zeros((min(width, sizes[g] - own * width), n_boot), TIMES)
        for b, places in zip(part["b"].tolist(), part["places"], strict=True):
            times[:, b] += np.bincount(np.frombuffer(places, np.uint16), minlength=len(times)).astype(TIMES)
        return pd.DataFrame({"g": g, "number": own * width + np.arange(len(times)), "times": [t.tobytes() for t in times]})

    return group


def drawn_by(spark: SparkSession, sizes: dict[int, int], n_boot: int, seeds: dict) -> DataFrame:
    """(g, number, times): of each group of so many units, how often each resample has each, from a seed of the group's own.

    All groups' stretches are one job's tasks. A generator as seed is left where its draws end.
    """
    rngs = {g: np.random.default_rng(seeds[g]) for g, n in sizes.items() if n}
    streams = {g: Stream(sizes[g], rng.bit_generator.state) for g, rng in rngs.items() if sizes[g] > 1}
    alone = [(g, 0, np.ones(n_boot, TIMES).tobytes()) for g in rngs if sizes[g] == 1]  # numpy takes nothing from its stream then
    schema, most = "g long, number long, times binary", 4 * spark.sparkContext.defaultParallelism
    single = spark.createDataFrame(alone, schema)
    if not streams:
        return single
    total = {g: s.n * n_boot for g, s in streams.items()}
    counts: dict[int, list[int]] = {g: [] for g in streams}
    while short := [g for g in streams if sum(counts[g]) < total[g]]:
        asked = []
        for g in short:
            bits = 32 if streams[g].narrow else 64
            stands = 1 - ((1 << bits) % streams[g].n) / 2**bits
            more = int((total[g] - sum(counts[g])) / stands / STRETCH * 1.001) + 1
            asked += [(g, len(counts[g]) + k) for k in range(more)]
        ids = spark.createDataFrame(pd.DataFrame(asked, columns=["g", "k"])).repartition(min(len(asked), most))
        for r in sorted(ids.mapInPandas(_standing({g: streams[g] for g in short}), "g long, k long, n long").collect()):  # a row a stretch
            counts[r.g].append(r.n)
    first_of = {g: [0, *np.cumsum(c).tolist()] for g, c in counts.items()}
    used = []
    for g, stream in streams.items():
        last = max(k for k, at in enumerate(first_of[g]) if at < total[g])
        used += [(g, k) for k in range(last + 1)]
        if isinstance(seeds[g], np.random.Generator):
            standing = np.flatnonzero(stream.draws(stream.words(last * STRETCH, (last + 1) * STRETCH))[1])
            rngs[g].bit_generator.state = stream.after(last * STRETCH + int(standing[total[g] - first_of[g][last] - 1]) + 1)
    width = max(1, min(1 << 16, DRAWS // n_boot))
    ids = spark.createDataFrame(pd.DataFrame(used, columns=["g", "k"])).repartition(min(len(used), most))
    rows = ids.mapInPandas(_dealt(streams, first_of, n_boot, width), "g long, own long, b long, places binary")
    return rows.groupBy("g", "own").applyInPandas(_counted(sizes, n_boot, width), schema).unionByName(single)


def drawn(spark: SparkSession, n: int, n_boot: int, seed) -> DataFrame:  # noqa: ANN001
    """(number, times) of one group."""
    return drawn_by(spark, {0: n}, n_boot, {0: seed}).drop("g")
