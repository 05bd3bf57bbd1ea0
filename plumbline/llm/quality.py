"""Quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles of the training rows. Boosting goes round the features in turn, each time
fitting a tree of few leaves to the gradient by that feature's bins and adding a little of it to the feature's lookup
table; the strongest pairs of features then get two-way tables in the same way. A score is the logistic of a sum of
looked-up numbers.

The fit takes about `sample` labelled documents of each label, chosen by a hash of the id; every whole text is scored.

Defined results: null, empty and wordless texts have features 0 and are scored as such. Null labels or ids teach
nothing. Without both labels the score is the labels' mean, or 1/2. Ties don't arise. Repeated rows are scored each. A
text of any length is scored whole, a block of words at a time; an empty table stays empty.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, tidy
from .features import NAMES, features, labelled_sample

SAMPLE, BINS, PAIR_BINS, PAIRS = 8000, 48, 8, 10
ROUNDS, RATE, LEAVES, LEAST = 150, 0.15, 4, 20


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, k], side="right")]
        coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.pair_edges)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def cut(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of bins in order; gain 0 if none leaves LEAST rows on both sides."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h, right_n = g.sum() - left_g, h.sum() - left_h, n.sum() - left_n
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(left_n < LEAST) | (right_n < LEAST)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A step function of bins, grown by the best cuts."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, part = max((*best_split(g[a:b], h[a:b], n[a:b]), (a, b)) for a, b in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], part[0] + at), (part[0] + at, part[1])]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """A step function of two features' bins: a cut of one, then of the other on either side; and its gain."""
    best = np.full(g.shape, g.sum() / (h.sum() + 1)), 0.0
    for axis in (0, 1):
        a, b, c = (m if axis == 0 else m.T for m in (g, h, n))
        for at in range(1, len(a)):
            out, score = np.empty(a.shape), -(a.sum() ** 2) / (b.sum() + 1)
            for side in (slice(0, at), slice(at, None)):
                p, q, r = a[side].sum(axis=0), b[side].sum(axis=0), c[side].sum(axis=0)
                _, k = best_split(p, q, r)
                for part in (slice(0, k), slice(k, None)):
                    if r[part].sum():
                        score += p[part].sum() ** 2 / (q[part].sum() + 1)
                    out[side, part] = p[part].sum() / (q[part].sum() + 1)
            if min(c[:at].sum(), c[at:].sum()) >= LEAST and score > best[1]:
                best = (out if axis == 0 else out.T), score
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    width = x.shape[1] if x.ndim == 2 else 0
    mean = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < mean < 1:
        at = 0.0 if not len(y) else np.log((mean + 0.01) / (1.01 - mean))
        return Model(at, [np.zeros(0)] * width, [np.zeros(1)] * width, [np.zeros(0)] * width, [], [])
    weight = np.where(y == 1, 0.5 / mean, 0.5 / (1 - mean))
    edges, coarse_edges = ([cut(x[:, k], n) for k in range(width)] for n in (BINS, PAIR_BINS))
    fine, coarse = ([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(es)] for es in (edges, coarse_edges))
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.zeros(len(y))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)

    sizes = [np.bincount(f, minlength=len(t)) for f, t in zip(fine, tables, strict=True)]
    for _ in range(ROUNDS):
        for f, t, n in zip(fine, tables, sizes, strict=True):
            g, h = slopes()
            step = RATE * tree(np.bincount(f, g, len(t)), np.bincount(f, h, len(t)), n)
            t += step
            z += step[f]
    g, h = slopes()
    ranked = []
    for a, b in itertools.combinations(range(width), 2):
        shape = len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1
        at = coarse[a] * shape[1] + coarse[b]
        sums = [np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, np.ones(len(y)))]
        ranked.append((pair_tree(*sums)[1], (a, b), at, shape))
    chosen = sorted(ranked, key=lambda r: (-r[0], r[1]))[:PAIRS]
    pair_tables = [np.zeros(r[3]) for r in chosen]
    for _ in range(ROUNDS // 3):
        for (_, _, at, shape), t in zip(chosen, pair_tables, strict=True):
            g, h = slopes()
            sums = [np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, np.ones(len(y)))]
            step = RATE * pair_tree(*sums)[0]
            t += step
            z += step.ravel()[at]
    return Model(0.0, edges, tables, coarse_edges, [r[1] for r in chosen], pair_tables)


def with_features(docs: DataFrame, score=None) -> DataFrame:
    """docs with an array of features in place of text, or with `score` of them: a broadcast function of many rows."""
    name = fresh(docs, "features" if score is None else "score")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(NAMES))
            if score is None:
                out = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), x.ravel())
            else:
                out = pa.array(score.value(x))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), out], names=[*names, name])

    kept = [f for f in docs.schema if f.name != "text"]
    new = T.StructField(name, T.ArrayType(T.DoubleType()) if score is None else T.DoubleType())
    return docs.mapInArrow(tidy(batches), T.StructType([*kept, new]))


def fitted(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of labels (doc_id, column) from the texts of docs."""
    rows = with_features(labelled_sample(docs, labels, [column], sample)).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit(np.array([r.features for r in rows]).reshape(-1, len(NAMES)), np.array([r[column] for r in rows], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the score of text in its place, named score, or with underscores before it if docs has such a column."""
    return with_features(docs, docs.sparkSession.sparkContext.broadcast(model))
