"""SimHash near-duplicates: exact links within a Hamming radius, by tiles of like population counts.

Fingerprints: over half the XXH64 hashes of all word shingles set a bit. Documents with one fingerprint are one node,
whose id is its smallest doc_id. Nodes are tiled by the population counts of the fingerprint's four 16-bit words:
two fingerprints within the radius have tiles within the radius (sum of differences), so each tile meets only those,
and whole tile pairs beyond are skipped. A tile larger than `tile_rows` is cut; a task holds one cut and streams the
others past it, numpy exclusive-or and bit counts telling the links. Each task sends on a spanning forest of its
links, and rounds of large and small stars, cut by checkpoints, join the forests.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other. Rows with one doc_id
are one document, so they share a component, and so do all that any of their texts links. A row without doc_id has a
fingerprint, no component, and links nothing. Ties don't arise: a component is its smallest id. A text of
any length is read whole, its words a block at a time. An empty table has no components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, compact, tidy, word_blocks, written

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a tile that a task holds at a time, and pairs that it compares at once.
TILE_ROWS, PAIRS = 4096, 1 << 20


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned; shingles are hashed a block of words at a time."""
    ones, total, before, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_digest
    for block in word_blocks((text or "").encode("utf-8", "replace").lower()):
        words = before + block
        if len(words) >= width:
            ends = np.cumsum([len(w) + 1 for w in words])
            begins = np.concatenate(([0], ends[:-width])).tolist()
            line = b" ".join(words)
            hashes = b"".join([digest(line[b:e], SEED) for b, e in zip(begins, (ends[width - 1 :] - 1).tolist(), strict=True)])
            flat = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
            ones += flat.sum(axis=0, dtype=np.int32)
            total += len(flat)
            words = words[len(words) - width + 1 :]
        before = words
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprinted(docs: DataFrame, name: str) -> DataFrame:
    """docs with the fingerprint of text, as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            prints = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(prints)], names=[*(n for n, _ in rest), name])

    return docs.mapInArrow(tidy(batches), T.StructType([*(f for f in docs.schema if f.name != "text"), T.StructField(name, T.LongType())]))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over links a - b."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low[low] != low).any():
            low = low[low]
        apart = low[a] != low[b]
        a, b = a[apart], b[apart]
    return low


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)


class _Tile:
    """The held part of a tile: nodes, fingerprints, and the forest of what has linked them."""

    def __init__(self, prints: np.ndarray, nodes: np.ndarray, radius: int):
        self.prints, self.nodes, self.radius = prints, nodes, radius
        self.at_once = max(1, PAIRS // len(prints))
        self.low = every = np.arange(len(prints))
        for k in range(0, len(prints), self.at_once):
            i, j = _near(prints[k : k + self.at_once], prints[k:], radius)
            keep = i < j
            self.low = _forest(len(prints), np.concatenate((every, i[keep] + k)), np.concatenate((self.low, j[keep] + k)))

    def meet(self, prints: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of partners that reach the tile, each to one of its nodes; their own links join its forest."""
        n, out = len(self.nodes), []
        for k in range(0, len(prints), self.at_once):
            i, j = _near(prints[k : k + self.at_once], self.prints, self.radius)
            if len(i):
                far, i = np.unique(i, return_inverse=True)
                low = _forest(n + len(far), np.concatenate((np.arange(n), i + n)), np.concatenate((self.low, j)))
                self.low = low[:n]
                out.append((nodes[k + far], self.nodes[low[n:]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (nodes[:0], nodes[:0])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = self.low != np.arange(len(self.low))
        return self.nodes[moved], self.nodes[self.low[moved]]


def _tile_links(radius: int):
    """Of rows (tile, part, partner, print, node) sorted by the first three: links (a, b)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile, held = None, None, []

        def made() -> _Tile | None:
            return _Tile(*map(np.concatenate, zip(*held, strict=True)), radius) if held else None

        def sent(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in it:
            tiles, parts, partner, prints, nodes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "part", "partner", "print", "node"))
            prints = prints.view(np.uint64)
            edges = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(parts) != 0) | (np.diff(partner) != 0)) + 1
            for begin, end in itertools.pairwise([0, *edges.tolist(), len(tiles)] if len(tiles) else []):
                if key != (tiles[begin], parts[begin]):
                    if tile := tile or made():
                        yield from sent(*tile.links())
                    key, tile, held = (tiles[begin], parts[begin]), None, []
                if not partner[begin]:
                    held.append((prints[begin:end], nodes[begin:end]))
                elif tile := tile or made():
                    yield from sent(*tile.meet(prints[begin:end], nodes[begin:end]))
        if tile := tile or made():
            yield from sent(*tile.links())

    return batches


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """nodes (print long, node long), each print once: a forest of links (a, b) with the components of all links."""
    words = [F.bit_count(F.shiftrightunsigned("print", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    tiled = nodes.select("print", "node", *(w.cast("int").alias(f"w{k}") for k, w in enumerate(words)))
    tile = lambda of: sum((of[k] * 17**k for k in range(1, 4)), of[0])
    own = tile([F.col(f"w{k}") for k in range(4)])
    # at most 17**4 rows, whatever the input
    cuts = F.broadcast(tiled.groupBy(own.alias("tile")).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts")))
    cut = tiled.join(cuts, own == F.col("tile")).withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    held = cut.select("tile", "part", F.lit(False).alias("partner"), "print", "node")
    later = cut.where(F.col("parts") > 1).withColumn("to", F.explode(F.expr("sequence(part + 1, parts)"))).where(F.col("to") < F.col("parts"))
    same = later.select("tile", F.col("to").alias("part"), F.lit(True).alias("partner"), "print", "node")
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=4) if 0 < sum(map(abs, s)) <= radius and s > (0, 0, 0, 0)]
    sent = tiled.withColumn("s", F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"s{k}") for k, x in enumerate(s))) for s in steps))))
    moved = [F.col(f"w{k}") + F.col(f"s.s{k}") for k in range(4)]
    for m in moved:
        sent = sent.where(m.between(0, 16))
    others = sent.join(cuts, tile(moved) == F.col("tile")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    others = others.select("tile", "part", F.lit(True).alias("partner"), "print", "node")
    rows = held.unionByName(same).unionByName(others).repartition("tile", "part").sortWithinPartitions("tile", "part", "partner")
    return rows.mapInArrow(tidy(_tile_links(radius)), "a long, b long")


def components(edges: DataFrame, most_links: int) -> DataFrame:
    """(node, low): the smallest node that each node with a link reaches, by alternating large and small stars.

    most_links: about how many links there are, by which the first files are sized.
    """
    edges = checkpointed(compact(edges.where("a <> b").distinct(), most_links))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpointed(compact(small, most_links if state is None else state[0]))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == state:
            return edges.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node")
        state = now


def _with_components(prints: DataFrame, radius: int) -> DataFrame:
    """prints (doc_id, print): (print, component_id), a row a fingerprint that some id has."""
    own = prints.where("doc_id IS NOT NULL")
    nodes = own.groupBy("print").agg(F.min("doc_id").alias("node"))
    nodes = checkpointed(compact(nodes, prints.count()))
    # ids with texts of several fingerprints: each is linked to the least
    several = own.groupBy("doc_id").agg(F.min("print").alias("least"), F.max("print").alias("most")).where("least <> most")
    same = own.join(several, "doc_id").where("print <> least").select("print", "least").distinct()
    same = same.join(nodes, "print").select(F.col("node").alias("a"), F.col("least").alias("print")).join(nodes, "print").select("a", F.col("node").alias("b"))
    low = components(links(nodes, radius).unionByName(same), nodes.count())
    return nodes.join(low, "node", "left").select("print", F.coalesce("low", "node").alias("component_id"))


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row a document."""
    prints = written(fingerprinted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "print"), "prints")
    known = _with_components(prints, radius)
    out = prints.join(known, "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs, its columns as they were, with the smallest doc_id of each component; one row of those that repeat it.

    Of rows that repeat an id that stays, that with the least text stays, then that with the least of all columns as
    JSON. Rows without doc_id can't be told apart or be named by a component, so they stay. Ids are decided on before
    any text is moved.
    """
    ids = simhash_components(docs, radius).where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("component_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("n"))
    odd = written(ids.where("NOT stays OR n > 1").select("doc_id", "stays"), "odd-ids")
    once = docs.join(odd.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = docs.join(odd.where("stays").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    row, place = F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns)))
    return once.unionByName(again.groupBy("doc_id").agg(F.min_by(row, place).alias("one_row")).select("one_row.*"))
