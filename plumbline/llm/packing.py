"""Packing along a space-filling curve: documents near each other in content share sequences.

A document's vector (counts of hashed byte trigrams, unit length) is projected to a few dimensions by a fixed random
matrix; its place on the Hilbert curve through these is its key. Rows are range-sorted by key and id, so a task has a
stretch of the curve, about as many bytes as any other, and a group of copies, which has one key, is spread by id. Each task tokenises its stretch and
cuts it into full sequences; what is left at its end goes into sequences whose lengths are powers of two, so no id of
padding is needed anywhere.

Defined results: null text is empty; an empty text is the end id alone. Repeated rows are each packed. A missing
doc_id stays missing. Documents with one key and id follow each other in any order. A text of any length is packed whole and
cut wherever a sequence ends. An empty table has no pieces. Extra columns are left out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, tidy

LENGTH, END = 2048, 1
BUCKETS, DIMENSIONS, BITS, REACH = 1024, 4, 15, 4.0
#: Bytes to a stretch of the curve at most, on average; rows picked to a stretch, to cut the curve.
PART_BYTES, PICKS, SEED = 256 << 20, 32, 5
#: Sorts with the rows that have no id.
NO_ID = -(1 << 63)
#: Characters on which both tokenizer libraries are known to cut alike; other texts go to the slower one.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points (n, dimensions) whose coordinates are under 2**bits."""
    x = x.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the excess work of each level
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def projected(text: str | None, matrix: np.ndarray) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BUCKETS)
    for k in range(0, max(len(data) - 2, 0), BLOCK):
        b = data[k : k + BLOCK + 2].astype(np.uint16)
        h = b[:-2] * np.uint16(40503) + b[1:-1] * np.uint16(30011) + b[2:] * np.uint16(9973)
        counts += np.bincount(h >> np.uint16(6), minlength=BUCKETS)
    return counts @ matrix / max(np.sqrt(counts @ counts), 1)


def keys(texts: pd.Series) -> np.ndarray:
    matrix = np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))
    points = np.array([projected(x, matrix) for x in texts]).reshape(-1, DIMENSIONS)
    return hilbert(np.clip((points + REACH) / (2 * REACH) * (1 << BITS), 0, (1 << BITS) - 1))


def curve_key(c) -> F.Column:
    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series(keys(texts))

    return key(c)


def stretch_of(key: np.ndarray, doc_id: np.ndarray, cut_keys: np.ndarray, cut_ids: np.ndarray) -> np.ndarray:
    """How many cuts (key, id), which are sorted, lie at or before each row."""
    out, equal = (np.searchsorted(cut_keys, key, side=side) for side in ("left", "right"))
    for k in np.unique(key[equal > out]):  # a key so common that it is cut by id
        at = key == k
        first, last = np.searchsorted(cut_keys, k, side="left"), np.searchsorted(cut_keys, k, side="right")
        out[at] = first + np.searchsorted(cut_ids[first:last], doc_id[at], side="right")
    return out


def stretches(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with their keys, each stretch of the curve a partition, in order.

    Stretches have about equal numbers of bytes, so that long documents that lie together don't make a long task: cuts are
    every PICKS-th of rows picked with chances in proportion to their bytes. Only where rows lie depends on the picks.
    """
    spark, size = docs.sparkSession, F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = docs.agg(F.sum(size)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    step = max(total, 1) / (PICKS * parts)
    picked = docs.withColumn("weight", F.greatest(size.cast("double"), F.lit(step))).where(F.rand(SEED) * step < size)
    picks = picked.select(curve_key(F.col("text")).alias("key"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "weight").toPandas().sort_values(["key", "doc_id"])
    upto = picks["weight"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)) if len(picks) else np.zeros(0, np.int64)
    cuts = spark.sparkContext.broadcast((picks["key"].to_numpy(np.int64)[at], picks["doc_id"].to_numpy(np.int64)[at]))

    @F.pandas_udf("key long, stretch int")
    def placed(doc_ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        key = keys(texts)
        return pd.DataFrame({"key": key, "stretch": stretch_of(key, doc_ids.to_numpy(np.int64), *cuts.value).astype(np.int32)})

    rows = docs.withColumn("place", placed(F.coalesce("doc_id", F.lit(NO_ID)), "text")).select("doc_id", "text", "place.key", "place.stretch")
    return rows.repartitionById(parts, "stretch").sortWithinPartitions("key", "doc_id", "text")


class Encoder:
    """Ids by tokenizers from a file of its format; by tiktoken from the same vocabulary's ranks where both agree."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(n) for token, n in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Takes documents' ids in order; gives pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.open, self.fill = length, first, [], 0

    def take(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            n = min(self.length - self.fill, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + n], len(ids)))
            at, self.fill = at + n, self.fill + n
            if self.fill == self.length:
                yield from self._closed(self.length)

    def _closed(self, size: int) -> Iterator[tuple]:
        """The first `size` open ids as a sequence."""
        offset, rest = 0, []
        for doc_id, start, ids, total in self.open:
            n = min(size - offset, len(ids))
            if n:
                yield doc_id, start, ids[:n], total, self.sequence, offset
            if n < len(ids):
                rest.append((doc_id, start + n, ids[n:], total))
            offset += n
        self.open, self.fill, self.sequence = rest, self.fill - size, self.sequence + 1

    def end(self) -> Iterator[tuple]:
        while self.fill:
            yield from self._closed(1 << self.fill.bit_length() - 1)


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian 32 bits), doc_tokens, sequence_id, offset."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = Encoder(tokenizer, ranks, pattern), Packer(length, TaskContext.get().partitionId() << 40), []

        def made() -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
            own = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            rows.clear()
            return pa.RecordBatch.from_arrays([*own, pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        last, known = None, None
        for batch in it:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if text != last:  # copies are neighbours
                    last, known = text, np.append(encode(text), np.uint32(end))
                for piece in packer.take(doc_id, known):
                    rows.append(piece)
                    if len(rows) == 1024:
                        yield made()
        rows.extend(packer.end())
        if rows:
            yield made()

    placed = stretches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return placed.select("doc_id", "text").mapInArrow(tidy(batches), PIECES)


def digests(pieces: DataFrame, *more: str) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)
