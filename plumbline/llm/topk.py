"""Exact top-k inner products by an impact-ordered index, score at a time.

Rows are indexed in blocks. In each dimension a block's rows lie in LEVELS posting segments by component; for a query
a segment's impact is the largest contribution that any of its rows can have. Segments are processed by descending
impact over all dimensions, adding impacts to their rows' totals; a row's total plus the next impact for each
dimension it hasn't met bounds its score from above. Once few rows can reach the query's k-th best score so far, that
bound is the proof that the others can't, and the few are scored exactly. The best so far are kept from block to block.

Queries are sent to the tasks in groups of about QUERIES (8 MB at 64 dimensions), each group a pass over the rows; each task sends on its k
best of each query, and a window takes the k best of these.

Defined results: vectors that are null or hold null or non-finite components take no part, as queries or candidates;
rows without id neither. Vectors shorter than others end in zeros. A query's own id is no candidate; repeated rows are
each. Of query rows that repeat an id the least vector counts. Ties go to the smaller id. An empty table, or
one without queries, gives nothing. Vectors of any length take part. Scores are exact; a vector whose
own square would pass 2**62 is refused, as products could pass 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written

K, LEVELS, BLOCK_ROWS, QUERIES = 10, 16, 8192, 16384
#: Shares of a block's postings after which the bounds are looked at.
LOOKS = (0.15, 0.25, 0.32, 0.38, 0.44, 0.5, 0.56, 0.63, 0.7, 0.8, 0.9, 1.0)


def quantised(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def whole(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


class Block:
    """An index over rows (n, dimensions) of whole numbers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, (self.n, self.dimensions) = ids, rows, rows.shape
        width = -(-self.n // LEVELS)
        order = np.argsort(rows, axis=0, kind="stable").T
        values = np.take_along_axis(rows, order.T, axis=0).T
        pad = width * LEVELS - self.n  # postings of row n, which stands for none, with the last row's value
        order = np.pad(order, ((0, 0), (0, pad)), constant_values=self.n)
        values = np.pad(values, ((0, 0), (0, pad)), mode="edge")
        self.postings = order.reshape(-1, width)  # a segment a line
        self.least, self.most = values.reshape(-1, width)[:, 0].copy(), values.reshape(-1, width)[:, -1].copy()
        self.few = 32 + self.n // 8  # scored exactly in less time than more segments take

    def search(self, query: np.ndarray, own: int, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The k best (-score, id) of `best` and the block's rows."""
        if not self.dimensions:
            return self._with(best, np.arange(self.n), query, own, k)
        q = np.repeat(query, LEVELS)
        impact = np.where(q > 0, q * self.most, q * self.least)
        order = np.argsort(-impact, kind="stable")
        totals, met, done = np.zeros(self.n + 1), np.zeros(self.n + 1, np.int64), 0
        possible, slack = np.arange(self.n), 1e-12 * np.abs(impact).sum()  # what rounding may take from a bound
        for look in LOOKS:
            upto = max(done + 1, round(look * len(order)))
            segments = order[done:upto]
            at = self.postings[segments].ravel()
            totals += np.bincount(at, np.repeat(impact[segments].astype(float), self.postings.shape[1]), self.n + 1)
            met += np.bincount(at, minlength=self.n + 1)
            done = upto
            rest = float(impact[order[done]]) if done < len(order) else 0.0
            bound = totals[: self.n] + (self.dimensions - met[: self.n]) * rest
            floor = best
            if len(best) < k:  # any k exact scores will do for a threshold
                floor = self._with([], np.argpartition(-bound, min(4 * k, self.n - 1))[: 4 * k], query, own, k)
            if len(floor) >= k:
                possible = np.flatnonzero(bound >= -floor[k - 1][0] - slack)
            if len(possible) <= self.few or done >= len(order):
                break
        return self._with(best, possible, query, own, k)

    def _with(self, best: list[tuple[int, int]], which: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        which = which[self.ids[which] != own]
        scores, ids = self.rows[which] @ query, self.ids[which]
        if len(which) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            sure, tied = scores > kth, scores == kth
            ids_tied = np.partition(ids[tied], k - 1)[:k] if tied.sum() > k else ids[tied]
            scores, ids = np.concatenate((scores[sure], np.full(len(ids_tied), kth))), np.concatenate((ids[sure], ids_tied))
        return sorted([*best, *zip((-scores).tolist(), ids.tolist(), strict=True)])[:k]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as lines of a matrix, ended by zeros or cut at width: no query reaches further."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    line = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[line[place < width], place[place < width]] = flat[place < width]
    return out


def _searcher(queries, k: int):  # noqa: ANN001
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = queries.value
        width = vectors.shape[1]
        best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        held, n = [], 0

        def searched() -> None:
            block = Block(np.concatenate([b.column("id").to_numpy() for b in held]), np.concatenate([_matrix(b.column("vector"), width) for b in held]))
            for i, own in enumerate(query_ids):
                best[i] = block.search(vectors[i], own, best[i], k)

        for batch in it:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(part := batch.slice(at, BLOCK_ROWS))
                n += part.num_rows
                if n >= BLOCK_ROWS:
                    searched()
                    held, n = [], 0
        if n:
            searched()
        rows = [(q, i, -s) for q, found in zip(query_ids, best, strict=True) for s, i in found]
        for at in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + 8192], strict=True)], names=["query_id", "vec_id", "score"])

    return batches


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """rows and queries (id long, vector array of long): query_id, rank from 1, vec_id, score."""
    spark = rows.sparkSession
    queries = checkpointed(queries.where("id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector")))
    groups = max(1, -(-queries.count() // QUERIES))
    found = None
    for g in range(groups):
        sent = sorted(queries.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).collect())
        vectors = np.zeros((len(sent), max((len(r.vector) for r in sent), default=0)), np.int64)
        for line, r in zip(vectors, sent, strict=True):
            line[: len(r.vector)] = r.vector
        best = rows.where("id IS NOT NULL").mapInArrow(_searcher(spark.sparkContext.broadcast(([r.id for r in sent], vectors)), k), "query_id long, vec_id long, score long")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        best = best if groups == 1 else written(best, "best")
        found = best if found is None else found.unionByName(best)
    return found.select("query_id", "rank", "vec_id", "score")


def vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """embeddings (vec_id, embedding) as whole numbers (id, vector), without those that take no part."""
    kept = embeddings.where(whole(F.col("embedding")))
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + F.pow(scale * x.cast("double"), F.lit(2)))
    vector = F.when(square < 2.0**62, quantised(F.col("embedding"), scale)).otherwise(F.raise_error(F.concat(F.lit("vector too long for whole-number scores: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    return kept.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector"))
