"""Bootstrap draws. Every statistic here is a function of sums over units, so a resample is a sum of unit rows with
multiplicities.

Two ways of drawing, told apart by the caller alone and never by size:

- keyed, where no order is given: a unit's multiplicity in a resample is Poisson with mean one and depends on the unit's
  key, the resample and the seed alone, by whole-number arithmetic that any engine can repeat. Nothing is shuffled but one
  row a task, statistic and block of resamples, and a recomputed task gives the same sums.
- numpy's own stream, where `order` numbers the units (see `stream`): resamples of as many units as there are, drawn by
  tasks, each from its own stretch of the stream. For results that must follow a seed of numpy's generator number by number.

Sums by label go to the driver where there are up to WIDE labels. Where there are more and only their totals and squares
matter, labels stay on the executors: cells are dealt out by ranges of labels, and a row a task reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stream import TIMES, drawn, drawn_by, numbered

#: Share of resamples that must give a number before an interval is reported.
USABLE = 0.90
#: Draws are numbers under this prime: a random cubic polynomial over it for each resample, of a random mix of a unit's halves.
PRIME = 2**31 - 1
#: Units are numbers of twice as many bits.
HALF = 30
#: Where a polynomial's value reaches these, the multiplicity is one more: Poisson's distribution times the prime.
THRESHOLDS = tuple(int(PRIME * sum(exp(-1 - lgamma(i + 1)) for i in range(k + 1))) for k in range(12))
#: Sums that a task holds at once: statistics times resamples.
SUMS = 8_000_000
#: Labels whose sums the driver takes.
WIDE = 4096
#: Rows up to which a table is dealt out anew before it is resampled.
SMALL = 20_000_000
CELLS = "unit long, i long, j long, x double"


def unit_key(*key: Column) -> Column:
    """A text that two units share only if all these columns are the same, nulls among them."""
    part = lambda k: F.coalesce(F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("n"))
    return F.concat(*map(part, key))


def unit_number(*key: Column) -> Column:
    """A number of 2 * HALF bits from the columns that tell a unit from the others."""
    return F.conv(F.substring(F.md5(unit_key(*key)), 1, 2 * HALF // 4), 16, 10).cast("long")


def polynomials(seed: int, first: int, last: int) -> np.ndarray:
    """(resamples, 5): of resamples from first to before last, the coefficients and what the lower half is mixed in by."""
    word = lambda b, k: int(hashlib.md5(f"{seed}:{b}:{k}".encode()).hexdigest()[:15], 16) % PRIME
    return np.array([[word(b, k) for k in range(5)] for b in range(first, last)], np.int64).reshape(-1, 5)


#: Values under PRIME fall into equal bins, nearly all of which have one multiplicity.
_SHIFT, _ORDERED = 19, np.array(THRESHOLDS)
_FIRST = np.arange(1 << 31 - _SHIFT, dtype=np.int64) << _SHIFT
_BIN = np.searchsorted(_ORDERED, _FIRST, side="right")
_MIXED = np.searchsorted(_ORDERED, _FIRST + (1 << _SHIFT) - 1, side="right") != _BIN


def _reduced(x: np.ndarray) -> np.ndarray:
    """Of x under k * 2**62, unsigned, a number that is x modulo PRIME and at most 2**31 * (k / 2 + 1)."""
    return (x & PRIME) + (x >> 31)


def poisson(units: np.ndarray, many: np.ndarray | None, polynomial: np.ndarray) -> np.ndarray:
    """Multiplicities of units by number, each of which stands for `many` equal ones, or for itself."""
    a0, a1, a2, a3, mix = polynomial.tolist()
    units = units.view(np.uint64)
    u = _reduced(_reduced((units >> HALF) + mix * (units & (1 << HALF) - 1)))  # 2**31 at most
    t = _reduced(a3 * u + a2)
    t = _reduced(t * u + a1)  # each product stays under 2**64
    t = _reduced(_reduced(t * u + a0)).view(np.int64)
    t = np.where(t >= PRIME, t - PRIME, t)
    bins = t >> _SHIFT
    out, mixed = _BIN[bins], np.flatnonzero(_MIXED[bins])
    out[mixed] = np.searchsorted(_ORDERED, t[mixed], side="right")
    if many is not None:
        for at in np.flatnonzero(many > 1).tolist():
            out[at] = _quantiles(int(many[at]))(t[at])
    return out


_KNOWN: dict[int, tuple[int, np.ndarray]] = {}


#: For blocks of resamples: bins that a value under PRIME falls into, each with its multiplicity, or EXACT where it has several
#: or a bin's edge is so near another multiplicity that rounding may pass it.
BINS, EXACT, _NEAR = 1 << 12, 255, 64
_EDGES = np.arange(BINS + 1) * (PRIME / BINS)
_LOWEST, _HIGHEST = np.searchsorted(_ORDERED, _EDGES[:-1] - _NEAR, side="right"), np.searchsorted(_ORDERED, _EDGES[1:] + _NEAR, side="right")
_TIMES = np.where(_LOWEST == _HIGHEST, _LOWEST, EXACT).astype(np.uint8)
_TIMES[[0, -1]] = EXACT  # PRIME is 0 again
#: Multiplicities that a block holds, of resamples in eights.
_BLOCK = 160_000


def _centred(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME, within half of it of 0."""
    x = x % PRIME
    return np.where(x > PRIME // 2, x - PRIME, x)


def _powers(units: np.ndarray) -> np.ndarray:
    """(19, units): products of both halves of the units, times 2**15 and plain, and ones, as numbers of bins."""
    h, low = (units >> HALF) % PRIME, (units & (1 << HALF) - 1) % PRIME
    h2, hl, low2 = h * h % PRIME, h * low % PRIME, low * low % PRIME
    m = np.stack([h, low, h2, hl, low2, h2 * h % PRIME, h2 * low % PRIME, h * low2 % PRIME, low2 * low % PRIME])
    return np.concatenate([_centred(m << 15), _centred(m), np.ones((1, len(units)), np.int64)]) * (BINS / PRIME)


def _factors(coefficients: np.ndarray) -> np.ndarray:
    """(resamples, 19): the polynomials multiplied out, what each product of _powers is taken times, in two parts of 15 bits."""
    a0, a1, a2, a3, mix = coefficients.T
    b2, b3 = a2 * mix % PRIME, a3 * mix % PRIME
    b33 = b3 * mix % PRIME
    c = _centred(np.stack([a1, a1 * mix, a2, 2 * b2, b2 * mix, a3, 3 * b3, 3 * b33, b33 * mix], axis=1))
    low = (c + (1 << 14) & (1 << 15) - 1) - (1 << 14)
    return np.concatenate([c - low >> 15, low, a0[:, None] + (PRIME << 18)], axis=1).astype(float)  # 2**30 bins more: none is negative


def _exactly(units: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """The multiplicity of each unit by the polynomial beside it."""
    a0, a1, a2, a3, mix = coefficients.T
    u = ((units >> HALF) + mix * (units & (1 << HALF) - 1)) % PRIME
    t = (a3 * u + a2) % PRIME
    t = (t * u + a1) % PRIME
    return np.searchsorted(_ORDERED, (t * u + a0) % PRIME, side="right")


def poisson_blocks(units: np.ndarray, coefficients: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """poisson() of units for all polynomials: blocks of resamples, each its first and (resamples, units).

    A block is one product of matrices, in which sums stay under 2**31 bins and are known to 2 units of a bin's 2**19; the
    few values in bins without one multiplicity are computed in whole numbers.
    """
    powers, factors = _powers(units), _factors(coefficients)
    step = max(8, _BLOCK // max(len(units), 1) // 8 * 8)
    for first in range(0, len(factors), step):
        bins = (factors[first : first + step] @ powers).astype(np.int32)
        bins &= BINS - 1
        times = np.empty(bins.shape, np.uint8)
        _TIMES.take(bins, out=times, mode="clip")
        flat = times.reshape(-1)
        odd = flat == EXACT
        if len(odd) % 8:
            at = np.flatnonzero(odd)
        else:  # most eights have none
            eights = np.flatnonzero(odd.view(np.uint64))
            at = (eights[:, None] * 8 + np.arange(8)).ravel()
            at = at[odd[at]]
        b, unit = np.divmod(at, len(units))
        flat[at] = _exactly(units[unit], coefficients[first + b])
        yield first, times


def _quantiles(mean: int):  # noqa: ANN202
    """Poisson's quantile function of values under PRIME, from its distribution within fifteen deviations of the mean."""
    if mean not in _KNOWN:
        if len(_KNOWN) > 1000:
            _KNOWN.clear()
        reach = 15 * int(mean**0.5) + 40
        low = max(0, mean - reach)
        k = np.arange(low + 1, mean + reach + 1)
        logs = np.concatenate(([low * log(mean) - mean - lgamma(low + 1)], np.log(mean / k)))
        _KNOWN[mean] = low, np.cumsum(np.exp(np.cumsum(logs)))
    low, upto = _KNOWN[mean]
    return lambda t: low + int(np.searchsorted(upto, (t + 0.5) / PRIME, side="right"))


def times_of(part: pd.DataFrame, coefficients: np.ndarray | None, first: int, last: int) -> np.ndarray:
    """(rows, resamples): the multiplicities of each row's unit, by its key, or as drawn for it."""
    if coefficients is None:
        return np.stack([np.frombuffer(t, TIMES)[first:last] for t in part["times"]]) if len(part) else np.zeros((0, last - first), TIMES)
    units, at, place = np.unique(part["unit"].to_numpy(np.int64), return_index=True, return_inverse=True)
    if "many" in part:
        many = part["many"].to_numpy(np.int64)[at]
        return np.stack([poisson(units, many, c) for c in coefficients], axis=1)[place]
    out = np.empty((len(units), len(coefficients)), np.int64)
    for b, times in poisson_blocks(units, coefficients):
        out[:, b : b + len(times)] = times.T
    return out[place]


def sorted_labels(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The different (i, j) of rows in order, and each row's place among them."""
    return np.unique(pdf[["i", "j"]].to_numpy(np.int64).reshape(-1, 2), axis=0, return_inverse=True)


def _partial(coefficients: np.ndarray | None, first: int, last: int):  # noqa: ANN202
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for part in batches:
            if not len(part):
                continue
            labels, column = sorted_labels(part)
            own = (_by_key(part, labels, column, coefficients) if coefficients is not None else _as_drawn(part, labels, column, first, last)).T
            for k, label in enumerate(map(tuple, labels.tolist())):
                total[label] = total[label] + own[k] if label in total else own[k].copy()
        if total:
            yield pd.DataFrame({"i": [i for i, _ in total], "j": [j for _, j in total], "sums": [s.tobytes() for s in total.values()]})

    return sums


def _by_key(part: pd.DataFrame, labels: np.ndarray, column: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    units, at, place = np.unique(part["unit"].to_numpy(np.int64), return_index=True, return_inverse=True)
    many = part["many"].to_numpy(np.int64)[at] if "many" in part else None
    x, own, dense = part["x"].to_numpy(float), np.empty((len(coefficients), len(labels))), None
    if len(units) * len(labels) <= SUMS:
        dense = np.bincount(place * len(labels) + column, x, len(units) * len(labels)).reshape(len(units), len(labels))
    blocks = poisson_blocks(units, coefficients) if many is None else ((b, poisson(units, many, c)[None]) for b, c in enumerate(coefficients))
    for first, block in blocks:
        if dense is not None:
            own[first : first + len(block)] = block.astype(float) @ dense
        else:
            for b, times in enumerate(block, first):
                own[b] = np.bincount(column, times[place] * x, len(labels))
    return own


def _as_drawn(part: pd.DataFrame, labels: np.ndarray, column: np.ndarray, first: int, last: int) -> np.ndarray:
    own, x, step = np.zeros((len(labels), last - first)), part["x"].to_numpy(float), 1000
    for at in range(0, len(part), step):
        rows = slice(at, at + step)
        order = np.argsort(column[rows], kind="stable")
        begins = np.flatnonzero(np.diff(column[rows][order], prepend=-1))
        weighed = times_of(part.iloc[rows], None, first, last)[order] * x[rows][order][:, None]
        own[column[rows][order][begins]] += np.add.reduceat(weighed, begins, axis=0)
    return own.T


def _added(part: pd.DataFrame) -> pd.DataFrame:
    whole = np.sum([np.frombuffer(s) for s in part["sums"]], axis=0)
    return pd.DataFrame({"i": part["i"][:1], "j": part["j"][:1], "sums": [whole.tobytes()]})


def some_seed(seed: int | None) -> int:
    return int(np.random.default_rng().integers(2**32)) if seed is None else seed


def resampled(cells: DataFrame, n_boot: int, seed, places: DataFrame | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
    """Of cells (unit, i, j, x): blocks of resamples, each with the labels (i, j) and the sums of x by resample and label.

    A unit has a row a label at most. A column `many` says how many equal units a row stands for; x is that of one.
    places (unit, place), a row a unit: the resamples are numpy's, of units numbered by place; units are their keys then.
    """
    if places is None:
        size, width = _shape(cells)
        yield from _blocks(_dealt(cells, size, n_boot), n_boot, some_seed(seed), width)
        return
    cells = with_draws(cells, places, n_boot, seed).persist()
    try:
        yield from _blocks(cells, n_boot, None, _shape(cells)[1])
    finally:
        cells.unpersist()


def as_drawn(cells: DataFrame, n_boot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """resampled() of cells that have their multiplicities, from with_draws."""
    return _blocks(cells, n_boot, None, _shape(cells)[1])


def _shape(cells: DataFrame) -> tuple[int, int]:
    """How many cells there are, and how many labels."""
    return tuple(cells.agg(F.count("*"), F.count_distinct("i", "j")).first())


def _dealt(cells: DataFrame, size: int, n_boot: int) -> DataFrame:
    """cells in partitions that have about SUMS multiplicities to make each: few rows lie in few, and the work is rows times resamples."""
    return cells if size > SMALL else cells.repartition(_parts(cells, size, n_boot), "unit")


def _parts(cells: DataFrame, size: int, n_boot: int) -> int:
    """Four a core at most, but as many as leave each no more than SMALL rows."""
    parts = min(-(-size * n_boot // SUMS), 4 * cells.sparkSession.sparkContext.defaultParallelism)
    return max(1, parts, -(-size // SMALL))


def _blocks(cells: DataFrame, n_boot: int, seed: int | None, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """resampled() of cells that are dealt out, by their keys or, without a seed, as drawn."""
    step = max(1, min(n_boot, SUMS // max(width, 1)))
    for first in range(0, n_boot, step):
        last = min(first + step, n_boot)
        parts = cells.mapInPandas(_partial(None if seed is None else polynomials(seed, first, last), first, last), "i long, j long, sums binary")
        rows = sorted(parts.groupBy("i", "j").applyInPandas(_added, "i long, j long, sums binary").collect())
        yield np.array([[r.i, r.j] for r in rows], np.int64).reshape(-1, 2), np.array([np.frombuffer(r.sums) for r in rows]).reshape(len(rows), last - first).T


def with_draws(cells: DataFrame, places: DataFrame, n_boot: int, seed) -> DataFrame:  # noqa: ANN001
    """cells with `times`, how often each resample has the unit, as numpy draws it from all that have a place."""
    numbers, n = numbered(places, "place")
    return cells.join(numbers.select("unit", "number"), "unit").join(drawn(cells.sparkSession, n, n_boot, seed), "number").drop("number")


def with_draws_by(cells: DataFrame, places: DataFrame, n_boot: int, seeds: Sequence[int]) -> DataFrame:
    """cells (g, unit, others) with `times`: group g's resamples are numpy's for seeds[g]; places has g too."""
    numbers, _ = numbered(places.withColumn("place", F.struct("g", "place")), "place")
    spark, sizes = cells.sparkSession, {r.g: r.n for r in places.groupBy("g").agg(F.count("*").alias("n")).collect()}  # a row a group
    known = sorted(sizes)
    starts = spark.createDataFrame(pd.DataFrame({"g": known, "start": np.cumsum([0, *(sizes[g] for g in known)])[:-1]}), "g long, start long")
    own = numbers.join(starts, "g").select("g", "unit", (F.col("number") - F.col("start")).alias("number"))
    return cells.join(own, ["g", "unit"]).join(drawn_by(spark, sizes, n_boot, {g: seeds[g] for g in known}), ["g", "number"]).drop("number")


def label_totals(cells: DataFrame, n_boot: int, seed, places: DataFrame | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
    """By j: for each resample the total of its labels' sums, and of their squares. As resampled, for any number of labels.

    Cells that have `times` were drawn before.
    """
    if "times" not in cells.columns and places is not None:
        cells = with_draws(cells, places, n_boot, seed)
    keyed = "times" not in cells.columns
    if not keyed:
        cells = cells.persist()
    try:
        return _label_totals(cells, n_boot, some_seed(seed) if keyed else None)
    finally:
        if not keyed:
            cells.unpersist()


def _label_totals(cells: DataFrame, n_boot: int, seed: int | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    size, width = _shape(cells)
    if width <= WIDE:
        out: dict[int, list] = {}
        for labels, sums in _blocks(cells if seed is None else _dealt(cells, size, n_boot), n_boot, seed, width):
            for j in np.unique(labels[:, 1]).tolist():
                own = sums[:, labels[:, 1] == j]
                out.setdefault(j, []).append((own.sum(axis=1), (own**2).sum(axis=1)))
        return {j: tuple(map(np.concatenate, zip(*blocks, strict=True))) for j, blocks in out.items()}
    coefficients = None if seed is None else polynomials(seed, 0, n_boot)
    ranged = cells.repartitionByRange("j", "i", "unit").sortWithinPartitions("j", "i")
    rows = ranged.mapInPandas(_by_label(coefficients, n_boot), "j long, i long, sums binary, squares binary").collect()  # a row a j and task, and two
    totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    cut: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        sums = np.frombuffer(r.sums)
        if r.squares is None:  # of a label that may lie in other tasks too
            cut[r.j, r.i] = cut.get((r.j, r.i), 0) + sums
        else:
            _add(totals, r.j, sums, np.frombuffer(r.squares))
    for (j, _), sums in cut.items():
        _add(totals, j, sums, sums**2)
    return totals


def _add(totals: dict, j: int, sums: np.ndarray, squares: np.ndarray) -> None:
    before = totals.get(j, (0, 0))
    totals[j] = before[0] + sums, before[1] + squares


def label_sums(batches: Iterator[pd.DataFrame], coefficients: np.ndarray | None, n_boot: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Of cells sorted by (j, i): each label with its sums by resample, in order."""
    label, total, step = None, np.zeros(n_boot), max(1, SUMS // max(n_boot, 1) // 4)
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.iloc[at : at + step]
            labels = part[["j", "i"]].to_numpy(np.int64)
            begins = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]).any(axis=1))))
            sums = np.add.reduceat(times_of(part, coefficients, 0, n_boot) * part["x"].to_numpy(float)[:, None], begins, axis=0)
            for own, row in zip(map(tuple, labels[begins].tolist()), sums, strict=True):
                if own == label:
                    total = total + row
                else:
                    if label is not None:
                        yield label, total
                    label, total = own, row
    if label is not None:
        yield label, total


def _by_label(coefficients: np.ndarray | None, n_boot: int):  # noqa: ANN202
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        cut, last = [], None
        for label, sums in label_sums(batches, coefficients, n_boot):
            if last is not None:
                if cut:
                    _add(totals, last[0][0], last[1], last[1] ** 2)
                else:
                    cut.append(last)  # the first may have begun in another task
            last = label, sums
        cut += [last] if last is not None else []  # and the last may go on in one
        out = [(j, i, s.tobytes(), None) for (j, i), s in cut] + [(j, None, s.tobytes(), q.tobytes()) for j, (s, q) in totals.items()]
        yield pd.DataFrame(out, columns=["j", "i", "sums", "squares"])

    return rows


def numpy_multiplicities(n: int, n_boot: int, seed, width: int = 1) -> Iterator[np.ndarray]:  # noqa: ANN001
    """(resamples, n) from numpy's stream of unit numbers, a bounded block of resamples at a time."""
    rng, step = np.random.default_rng(seed), max(1, min(4_000_000 // max(n, 1), SUMS // max(width, 1)))
    for at in range(0, n_boot, step):
        picks = rng.integers(0, n, size=(min(step, n_boot - at), n))
        yield np.stack([np.bincount(p, minlength=n) for p in picks])


def resampled_means(rows: DataFrame, x: Column, key: Sequence[str], order: Sequence[str], n_boot: int, seed, size: int | None = None) -> np.ndarray:  # noqa: ANN001
    """Means of x over resamples of rows: numpy's if `order` numbers them, else keyed by `key`, or by x itself where that is empty.

    size: how many rows there are, where that is known; they are counted otherwise. Keyed rows are dealt out as units with
    their values, whatever their number, as the work is theirs and not that of the partitions they come in.
    """
    pairs = lambda own, unit, *more: own.select(unit, *more, F.inline(F.array(*(F.struct(F.lit(0).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), v.alias("x")) for j, v in enumerate((F.lit(1.0), F.col("own_x")))))))
    value = x.cast("double").alias("own_x")
    if order:  # each row is a unit
        numbers, n = numbered(rows.select(F.struct(*order).alias("place"), unit_key(*map(F.col, order)).alias("unit"), value), "place")
        blocks = _blocks(pairs(numbers, "number").join(drawn(rows.sparkSession, n, n_boot, seed), "number"), n_boot, None, 2)
    elif key:
        own = rows.select(unit_number(*map(F.col, key)).alias("unit"), value)
        own = own.repartition(_parts(own, rows.count() if size is None else size, n_boot), "unit")
        blocks = _blocks(pairs(own, "unit"), n_boot, some_seed(seed), 2)
    else:
        own = rows.select(value).groupBy("own_x").agg(F.count("*").alias("many"))
        blocks = resampled(pairs(own.select(unit_number(F.col("own_x")).alias("unit"), "own_x", "many"), "unit", "many"), n_boot, seed)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.concatenate([sums[:, 1] / sums[:, 0] for _, sums in blocks])


def percentile_interval(values: np.ndarray, confidence: float) -> tuple[float, float]:
    """Of the values that are numbers."""
    tail, good = 100 * (1 - confidence) / 2, values[np.isfinite(values)]
    return tuple(map(float, np.percentile(good, [tail, 100 - tail]))) if len(good) else (float("nan"), float("nan"))


def usable_interval(values: np.ndarray, confidence: float) -> tuple[float, float, int]:
    """Percentiles of the values that are numbers, and their count; no interval below the share USABLE."""
    n = int(np.isfinite(values).sum())
    if n < USABLE * len(values) or not n:
        return float("nan"), float("nan"), n
    return *percentile_interval(values, confidence), n


def bootstrap_p(values: np.ndarray) -> float:
    good = values[np.isfinite(values)]
    side = min((good <= 0).mean(), (good >= 0).mean())
    return float(min(max(2 * side, 1 / len(good)), 1.0))


def running(df: DataFrame, order: str, value: str, name: str, parts: int = 32) -> DataFrame:
    """df with the sum of `value` over rows that come before by a numeric column without ties.

    Ranges between quantiles are summed on their own and then moved by the sums of the ranges before, so no task
    sorts all rows.
    """
    bounds = sorted(set(df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.005)))
    place = F.lit(0)
    for b in bounds:
        place = place + (F.col(order) >= b).cast("int")
    df = df.withColumn("running_part", place)
    before = Window.orderBy("running_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    moved = df.groupBy("running_part").agg(F.sum(value).alias("part_sum")).select("running_part", F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("moved"))
    inside = Window.partitionBy("running_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(moved), "running_part")
    return out.withColumn(name, F.col(name) + F.col("moved")).drop("running_part", "moved")
