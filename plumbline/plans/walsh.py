"""Walsh averages by their place in order, without their list: counted from distinct values and how often each occurs.

Up to RANGE distinct values the driver counts. Beyond, values lie in ranges of about RANGE each, and a task counts one
range's averages with the ranges that its bounds allow; the driver holds a row a range. Both give the same doubles, those
of the listed averages.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 1_000_000
#: Places that one pass over the ranges counts at, for each average wanted.
PROBES = 63


def dot(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of whole numbers, past 64 bits too: the wrapped one, put right by the rounded one."""
    wrapped = int(a @ b)
    return wrapped + round((float(a.astype(float) @ b.astype(float)) - wrapped) / 2**64) * 2**64


def partners(x: np.ndarray, y: np.ndarray, v: float) -> np.ndarray:
    """How many of y, which are sorted, have an average with each x, rounded as it is, of at most v."""
    if not len(y):
        return np.zeros(len(x), np.int64)
    upto = np.searchsorted(y, 2 * v - x, side="right")
    while (more := (upto < len(y)) & ((x + y[np.minimum(upto, len(y) - 1)]) / 2 <= v)).any():
        upto = upto + more
    while (less := (upto > 0) & ((x + y[np.maximum(upto - 1, 0)]) / 2 > v)).any():
        upto = upto - less
    return upto


def upto(n: np.ndarray) -> np.ndarray:
    """Sums of n before each place, and of all."""
    return np.concatenate(([0], np.cumsum(n)))


def average_at(x: np.ndarray, n: np.ndarray, k: int) -> float:
    """The k-th of the averages of pairs i <= j of sorted x, each there n times; by bisection down to neighbouring doubles."""
    before = upto(n)
    at_most = lambda v: (dot(n, before[partners(x, x, v)]) + int(n[x <= v].sum())) // 2
    low, high = float(x[0]), float(x[-1])
    while True:
        mid = (low + high) / 2
        if mid in (low, high):
            return high if at_most(low) <= k else low
        if at_most(mid) > k:
            high = mid
        else:
            low = mid


def _rank(v: float) -> int:
    """The place of a double among all doubles; 0 for either zero."""
    bits = int(np.float64(v).view(np.int64))
    return bits if bits >= 0 else -(bits & (2**63 - 1))


def _double(rank: int) -> float:
    return float(np.int64(rank).view(np.float64)) if rank >= 0 else -float(np.int64(-rank).view(np.float64))


def _counted(probes: dict[int, list[float]], base: dict[tuple[int, int], int]):  # noqa: ANN202
    """Of a range's rows (mine) and those it may meet: twice the averages of at most each probe."""

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wanted, own = map(int, key)
        mine, met = (rows[rows["mine"] == side].sort_values("d") for side in (True, False))
        x, n, y, before = mine["d"].to_numpy(), mine["n"].to_numpy(), met["d"].to_numpy(), upto(met["n"].to_numpy()) + base[wanted, own]
        twice = [dot(n, before[partners(x, y, v)]) + int(n[x <= v].sum()) for v in probes[wanted]]
        return pd.DataFrame({"wanted": wanted, "probe": range(len(twice)), "twice": [Decimal(t) for t in twice]})

    return group


def _by_ranges(values: DataFrame, distinct: int, places: list[int]) -> list[float]:
    spark, parts = values.sparkSession, -(-distinct // RANGE)
    cuts = np.unique(values.approxQuantile("d", [k / parts for k in range(1, parts)], 0.1 / parts))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(part=np.searchsorted(cuts, rows["d"], side="right").astype(np.int32))

    ranged = values.mapInPandas(placed, "d double, n long, part int").persist()
    try:
        ranges = ranged.groupBy("part").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.sum("n").alias("n")).toPandas().sort_values("part")
        part, low, high, n = (ranges[c].to_numpy() for c in ("part", "low", "high", "n"))
        before = upto(n)
        # with a range's ends in place of its values, no average is above, and none below, what it was
        open_ = {k: [_rank(average_at(low, n, k)) - 1, _rank(average_at(high, n, k))] for k in set(places)}
        while any(b - a > 1 for a, b in open_.values()):
            ranks = {k: sorted({a + (b - a) * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {a}) for k, (a, b) in open_.items() if b - a > 1}
            probes, rows, base = {k: [_double(r) for r in of] for k, of in ranks.items()}, [], {}
            for k, at in probes.items():
                first, last = partners(high, high, at[0]), partners(low, low, at[-1])  # ranges before first are met whole
                for i, own in enumerate(part.tolist()):
                    base[k, own] = int(before[min(first[i], last[i])])
                    rows += [(own, k, own, True), *((int(part[j]), k, own, False) for j in range(first[i], last[i]))]
            meets = F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["part", "wanted", "own", "mine"]), "part int, wanted long, own int, mine boolean"))
            found = ranged.join(meets, "part").groupBy("wanted", "own").applyInPandas(_counted(probes, base), "wanted long, probe int, twice decimal(38,0)")
            sums = {(r.wanted, r.probe): int(r.twice) // 2 for r in found.groupBy("wanted", "probe").agg(F.sum("twice").alias("twice")).collect()}
            for k, of in ranks.items():
                past = [sums[k, i] > k for i in range(len(of))]
                cut = past.index(True) if any(past) else len(of)
                open_[k] = [of[cut - 1] if cut else open_[k][0], of[cut] if cut < len(of) else open_[k][1]]
    finally:
        ranged.unpersist()
    return [_double(open_[k][1]) for k in places]


def averages_at(values: DataFrame, distinct: int, places: list[int]) -> list[float]:
    """Of values (d, n), a row each of so many distinct ones: the averages at these places, from 0, in order of size."""
    if distinct > RANGE:
        return _by_ranges(values, distinct, places)
    rows = values.toPandas().sort_values("d")  # at most RANGE
    return [average_at(rows["d"].to_numpy(), rows["n"].to_numpy(), k) for k in places]
