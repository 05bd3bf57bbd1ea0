"""Toxicity by a chain of linear classifiers.

Categories come in a given order. Each has a logistic model over words and word beginnings present in the text, the
form features, and the log odds of the categories before it; in training these are predictions from folds that hadn't
seen the row, nor chosen features by it. Of the sparse features those stay that tell the category's rows from others, in
the rows that the model learns from, by SCREEN standard errors. Folds are dealt by a hash of the id. Each model is the
one maximum of its ridge-penalised likelihood, found by Newton steps.

Categories are columns of the labels; a caller may put other labels than toxicity first, as op8 does with poor quality.
The fit takes about `sample` labelled documents of each value of the last category, chosen by a hash of the id; every
whole text is scored.

Defined results: null, empty and wordless texts have no sparse features and form features 0. Null labels or ids teach
nothing. A category without both labels has its mean, or 1/2 without any, as everyone's probability. Ties don't
arise. Repeated rows are scored each. A column that a score's name would clash with keeps its name, and the score's gets
underscores before it. A text of any length is scored whole, a block of words at a time; an empty table stays empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, tidy, written
from .features import NAMES, features, labelled_sample
from .langid import runs

SAMPLE, FOLDS, SCREEN, LEAST = 3000, 5, 5.0, 5
BEGINNINGS = (4, 5, 6)
#: BALANCE 1 would weigh both labels alike, 0 each row.
RIDGE, BALANCE = 0.3, 0.5
#: Newton steps, and conjugate directions of each, at most.
STEPS, DIRECTIONS = 50, 200
#: Words, of up to so many letters, whose features a worker remembers.
REMEMBERED, REMEMBERED_LETTERS = 200_000, 40
#: Characters of text that are scored at a time; one text more may come on top.
CHARS = 1 << 21


def parts(word: str) -> list[str]:
    """A word's sparse features: itself, and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Linear:
    """Logistic regression over present sparse features and standardised dense ones."""

    names: dict[str, int]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def log_odds(self, sparse: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """sparse: each row's sum of weights over its present features."""
        return np.clip(self.base + sparse + np.clip((dense - self.centre) / self.scale, -4, 4) @ self.weights[len(self.names) :], -30, 30)

    def sums(self, tokens: list[set[str]]) -> np.ndarray:
        return np.array([sum(self.weights[self.names[t]] for t in sorted(row) if t in self.names) for row in tokens], float)


def screened(tokens: list[set[str]], y: np.ndarray) -> dict[str, int]:
    """Features whose share among the rows of y = 1 differs from the others' by SCREEN standard errors."""
    yes, no = Counter(), Counter()
    for t, label in zip(tokens, y, strict=True):
        (yes if label else no).update(t)
    a, b = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    kept = []
    for t in sorted(set(yes) | set(no)):
        p, q, n = yes[t] / a, no[t] / b, yes[t] + no[t]
        share = n / len(y)
        if n >= LEAST and abs(p - q) >= SCREEN * np.sqrt(share * (1 - share) * (1 / a + 1 / b) + 1e-12):
            kept.append(t)
    return {t: k for k, t in enumerate(kept)}


def indices(tokens: list[set[str]], names: dict[str, int]) -> list[np.ndarray]:
    return [np.array(sorted(names[t] for t in row if t in names), np.int64) for row in tokens]


def least(rows: np.ndarray, columns: np.ndarray, z: np.ndarray, n_names: int, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of the present features, the dense ones and the base, at the least of cost times log loss and half RIDGE times the squares of all but the base."""
    n = len(y)
    ridge = np.append(np.full(n_names + z.shape[1], RIDGE), 0.0)
    ahead = lambda w: w[-1] + np.bincount(rows, w[columns], n) + z @ w[n_names:-1]
    back = lambda m: np.concatenate((np.bincount(columns, m[rows], n_names), z.T @ m, [m.sum()]))

    def loss(w: np.ndarray, odds: np.ndarray) -> float:
        return float(cost @ (np.logaddexp(0, odds) - y * odds) + ridge @ (w * w) / 2)

    w = np.zeros(n_names + z.shape[1] + 1)
    odds = ahead(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-odds))
        slope, curve = back(cost * (p - y)) + ridge * w, cost * p * (1 - p)
        if np.abs(slope).max() < 1e-8 * n:
            break
        move, rest = np.zeros_like(w), -slope
        way, size = rest.copy(), rest @ rest
        enough = size * 1e-16
        for _ in range(DIRECTIONS):
            bent = back(curve * ahead(way)) + ridge * way + 1e-9 * way
            step = size / (way @ bent)
            move += step * way
            rest -= step * bent
            before, size = size, rest @ rest
            if size <= enough:
                break
            way = rest + size / before * way
        now, share = loss(w, odds), 1.0
        while share > 1e-6 and loss(w + share * move, ahead(w + share * move)) > now + 1e-4 * share * (slope @ move):
            share /= 2
        w = w + share * move
        odds = ahead(w)
    return w


def fit(tokens: list[set[str]], dense: np.ndarray, y: np.ndarray) -> Linear:
    """The rarer label is weighed up."""
    centre = dense.mean(axis=0) if len(y) else np.zeros(dense.shape[1])
    scale = np.maximum(dense.std(axis=0), 1e-3) if len(y) else np.ones(dense.shape[1])
    mean = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < mean < 1:
        return Linear({}, centre, scale, np.zeros(dense.shape[1]), 0.0 if not len(y) else float(np.log((mean + 0.01) / (1.01 - mean))))
    names = screened(tokens, y)
    present = indices(tokens, names)
    rows, columns = np.repeat(np.arange(len(y)), [len(p) for p in present]), np.concatenate(present)
    cost = np.where(y == 1, (0.5 / mean) ** BALANCE, (0.5 / (1 - mean)) ** BALANCE)
    w = least(rows, columns, np.clip((dense - centre) / scale, -4, 4), len(names), y, cost)
    return Linear(names, centre, scale, w[:-1], float(w[-1]))


class _Known(dict):
    """Numbers of the features that a word has among the named ones; long words are not remembered."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = tuple(self.numbers[p] for p in parts(word) if p in self.numbers)
        if len(word) <= REMEMBERED_LETTERS:
            self[word] = got
        return got


class Chain:
    def __init__(self, categories: list[str], models: list[Linear]):
        self.categories, self.models = categories, models
        names = sorted(set().union(*(m.names for m in models)))
        self.known = _Known({t: k for k, t in enumerate(names)})
        self.weights = np.array([[m.weights[m.names[t]] if t in m.names else 0.0 for m in models] for t in names]).reshape(len(names), len(models))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """(texts, categories): probabilities."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        present = [set().union(*map(self.known.__getitem__, set(runs(t)))) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(p) for p in present])
        columns = np.fromiter((k for p in present for k in p), np.int64, len(rows))
        dense, odds = np.array([features(t) for t in texts]).reshape(-1, len(NAMES)), np.zeros((len(texts), 0))
        for k, m in enumerate(self.models):
            odds = np.column_stack((odds, m.log_odds(np.bincount(rows, self.weights[columns, k], len(texts)), np.column_stack((dense, odds)))))
        return 1 / (1 + np.exp(-odds))


def all_tokens(text: str | None) -> set[str]:
    return {p for w in set(runs(text)) for p in parts(w)}


def learned(tokens: list[set[str]], dense: np.ndarray, y: np.ndarray, categories: list[str], fold: np.ndarray) -> Chain:
    """From texts' sparse and form features; y: (texts, categories) of 0 and 1; fold: each text's."""
    models = []
    for k in range(len(categories)):
        models.append(fit(tokens, dense, y[:, k]))
        if k + 1 < len(categories):
            unseen = np.zeros(len(tokens))
            for f in range(FOLDS):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                part = fit([tokens[i] for i in inside], dense[inside], y[inside, k])
                unseen[outside] = part.log_odds(part.sums([tokens[i] for i in outside]), dense[outside])
            dense = np.column_stack((dense, unseen))
    return Chain(categories, models)


def telling(rows: DataFrame, categories: list[str]) -> set[str]:
    """Sparse features of rows (text, fold, categories) that pass some fit's screen, of all rows or of all but a fold.

    Counted on the executors. No fit loses a feature that its own rows would choose, nor gets one by rows it leaves out.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            labels = [batch.column(c).to_pylist() for c in categories]
            sums: dict[tuple[str, int], list[int]] = {}
            for k, (text, fold) in enumerate(zip(batch.column("text"), batch.column("fold").to_pylist(), strict=True)):
                own = [1, *(column[k] for column in labels)]
                for t in all_tokens(text.as_py()):
                    sums[t, fold] = [a + b for a, b in zip(sums[t, fold], own, strict=True)] if (t, fold) in sums else own
            if sums:
                words, folds = zip(*sums, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(folds, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*sums.values(), strict=True))], names=["t", "fold", "n", *names])

    names, folds = [f"y{k}" for k in range(len(categories))], range(FOLDS)
    sizes = {r.fold: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for c, name in zip(categories, names, strict=True))).collect()}
    if not sizes:
        return set()
    counts = rows.select("text", "fold", *categories).mapInArrow(batches, ", ".join(["t string", "fold long", "n long", *(f"{c} long" for c in names)]))
    counts = counts.groupBy("t").agg(*(F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for c in ("n", *names) for f in folds))
    keep = F.lit(False)
    for out in (None, *folds):
        own = [f for f in folds if f != out]
        total = sum(sizes[f].n for f in own if f in sizes)
        n = sum((F.col(f"n_{f}") for f in own), F.lit(0))
        for name in names:
            yes, ones = sum(sizes[f][name] for f in own if f in sizes), sum((F.col(f"{name}_{f}") for f in own), F.lit(0))
            a, b, share = max(yes, 1), max(total - yes, 1), n / max(total, 1)
            gap = F.abs(ones / a - (n - ones) / b)
            keep = keep | ((n >= LEAST) & (gap >= 0.999 * SCREEN * F.sqrt(share * (1 - share) * (1 / a + 1 / b))))
    return {r.t for r in counts.where(keep).select("t").collect()}


def described(rows: DataFrame, categories: list[str], names: set[str]) -> DataFrame:
    """rows with those of the named features that text has and its form features, in place of text."""
    sent = rows.sparkSession.sparkContext.broadcast(names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [t.as_py() for t in batch.column("text")]
            tokens = [sorted(all_tokens(t) & sent.value) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), *map(batch.column, categories), pa.array(tokens, pa.list_(pa.string())), pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))], names=["doc_id", "fold", *categories, "tokens", "form"])

    return rows.mapInArrow(batches, ", ".join(["doc_id long", "fold long", *(f"{c} int" for c in categories), "tokens array<string>", "form array<double>"]))


def fitted(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> Chain:
    """The texts stay on the executors; their form features and the sparse ones that tell go to the driver."""
    rows = labelled_sample(docs, labels, categories, sample).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("long")), "labelled")
    found = sorted(described(rows, categories, telling(rows, categories)).collect(), key=lambda r: r.doc_id)
    y = np.array([[r[c] for c in categories] for r in found], float).reshape(-1, len(categories))
    return learned([set(r.tokens) for r in found], np.array([r.form for r in found]).reshape(-1, len(NAMES)), y, categories, np.array([r.fold for r in found], np.int64))


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with a probability for each category, named <category>_score, in place of text."""
    sent = docs.sparkSession.sparkContext.broadcast((chain.categories, chain.models))
    scores = [fresh(docs, f"{c}_score") for c in chain.categories]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Chain(*sent.value)
        for batch in it:
            found, held, size = [np.zeros((0, len(scores)))], [], 0
            for text in batch.column("text"):
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size > CHARS:
                    found.append(use(held))
                    held, size = [], 0
            found.append(use(held))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *map(pa.array, np.concatenate(found).T.copy())], names=[*names, *scores])

    kept = [f for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(tidy(batches), T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for c in scores)]))
