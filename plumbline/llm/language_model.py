"""Language-model scores from a hierarchical Pitman-Yor model over words.

A word's context is the word before it, and each context seen has a restaurant of its own, known by a 64-bit key;
restaurants whose words end alike share one of sixteen parents, and all parents share the root, whose base is uniform
over the V words seen and one for all others. Customers of a dish sit at tables, and each table is a customer of the
parent. Gibbs sweeps draw each dish's number of tables in each restaurant given all else: from the exact conditional
(Stirling numbers) up to EXACT customers, and beyond by seating the further ones in blocks of a fiftieth of those
seated. Discount and strength of the contexts' restaurants and the strengths of the others are drawn anew from their
conditionals after the first sweeps and after the last; the parents' and the root's discounts follow from how many
dishes have one and two customers there. The predictive probabilities of several sweeps are averaged.

The model is dealt out by word hash into buckets, about one to BUCKET_BYTES of text. Seatings of one word depend on
others only through the restaurants' totals. Those of the parents and the root are 34 numbers that all share; those of
the contexts lie in as many shards as there are buckets: a bucket sends its sums to the contexts' shards and gets the
whole totals of its own contexts back, so that no task and no driver holds all contexts. A sweep goes over the buckets in
parallel with the totals of the sweeps before. Counts are summed within chunks of text before they are shuffled.

Scoring sends a chunk's pairs of word and context, with the documents they are in, to the words' buckets and sums back by
chunk; pairs whose context the bucket does not know go on to the context's shard. Pairs that make up HEAD of all tokens or more, at most 1 / HEAD of them, are
scored where they are. A bucket has all contexts of its words.

Defined results: null and empty texts are one token, the end. Without training text each score is 0. Repeated rows
count and are scored each. Ties don't arise. Words are known by 64-bit hashes, contexts by 44 bits of these and the parent. A text of any length is cut
into blocks of words; one longer than a chunk makes its own. Extra columns are left out. An empty table gives nothing.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import word_blocks, written

PARENTS = 16
#: Of a context's key, the bits after its parent's number.
PARENT_BIT = np.uint64(44)
#: Keys under this are no word's in practice: contexts that were not seen.
CONTEXTS = 256
END = b"\n"
#: Bytes of text to a chunk and a bucket; buckets at least.
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 12 << 20, 12 << 20, 16
HEAD = 1e-4
EXACT, GROWTH, SEED = 200, 0.02, 17
#: Sweeps before the totals are renewed, and before each of the samples that are averaged.
BURN_IN, SAMPLES = 3, (2, 2)
STRENGTH = 1.0
#: Discounts and strengths at which the evidence about them is taken.
DISCOUNTS, STRENGTHS = np.arange(1, 20) / 20, np.geomspace(0.03, 1000, 28)
#: Where shared totals lie: customers and tables of parent and root restaurants; tokens; dishes; leaf, parent and root dishes
#: of 1 and 2 customers; and the leaf dishes' evidence at each of DISCOUNTS.
PARENT, ROOT, TOKENS, DISHES, ONES, DISH_EVIDENCE = 0, 2 * PARENTS, 2 * PARENTS + 2, 2 * PARENTS + 3, 2 * PARENTS + 4, 2 * PARENTS + 10
TOTALS = DISH_EVIDENCE + len(DISCOUNTS)


class Ids(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def contexts_of(words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """The key of the restaurant after each word: its parent's number by the last two bytes, then the hash."""
    ends = np.array([w[-2:] for w in words], "S2").view("<u2").astype(np.uint32)
    parent = (ends * np.uint32(2654435761)) >> np.uint32(16)
    return (parent % PARENTS).astype(np.uint64) << PARENT_BIT | hashes >> np.uint64(64) - PARENT_BIT


def parents_of(contexts: np.ndarray) -> np.ndarray:
    return (contexts.astype(np.uint64) >> PARENT_BIT).astype(np.int64)


def shards_of(contexts: np.ndarray, shards: int) -> np.ndarray:
    return ((contexts & ((np.uint64(1) << PARENT_BIT) - np.uint64(1))) % np.uint64(shards)).astype(np.int64)


def pair_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Hashes of pairs of a word's hash and a context's key."""
    with np.errstate(over="ignore"):
        x = (words ^ contexts * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted among sorted keys; -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], n, asbytes=True) if n else b""


def planes(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers byte by byte, compressed."""
    x = np.ascontiguousarray(x, kind)
    return squeezed(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unplanes(data: bytes, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueezed(data), np.uint8).reshape(size, -1).T).view(kind).ravel().astype(np.int64)


def ascending(x: np.ndarray) -> bytes:
    """Sorted 64-bit keys by their differences."""
    return planes(np.diff(x, prepend=np.uint64(0)), "<u8")


def unascending(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, "<u8").view(np.uint64), dtype=np.uint64)


def counts(x: np.ndarray) -> bytes:
    """Whole numbers, nearly all of which are small, at a byte each; 255 stands for those listed first."""
    x = np.ascontiguousarray(x, np.int64)
    large = np.flatnonzero(x >= 255)
    return squeezed(np.array([len(large)], "<u4").tobytes() + large.astype("<u4").tobytes() + x[large].astype("<u8").tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes())


def uncounts(data: bytes) -> np.ndarray:
    data = unsqueezed(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.frombuffer(data, np.uint8, offset=4 + 12 * n).astype(np.int64)
    out[np.frombuffer(data, "<u4", n, 4)] = np.frombuffer(data, "<u8", n, 4 + 4 * n)
    return out


class Chunk:
    """Documents' words, each document ended, so that the word before a document's first is the end."""

    def __init__(self) -> None:
        self.ids, self.flat, self.sizes, self.bytes = Ids(), [], [], 0
        self.ids[END] = 0

    def add(self, text: str | None) -> None:
        data, n = (text or "").encode("utf-8", "replace").lower(), 1
        for words in word_blocks(data):
            self.flat.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
            n += len(words)
        self.flat.append(np.zeros(1, np.int32))
        self.sizes.append(n)
        self.bytes += len(data) + 64

    def arranged(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gives up the texts. Hashes in order of bucket and hash, where each bucket begins, each token's place there, sorted keys of contexts, and each token's among them."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.ids), np.uint64, len(self.ids))
        bucket = (hashes >> np.uint64(20)) % np.uint64(buckets)
        order = np.lexsort((hashes, bucket))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        flat = np.concatenate(self.flat)
        leaves, leaf = np.unique(contexts_of(list(self.ids), hashes), return_inverse=True)
        self.ids, self.flat = Ids(), []
        return hashes[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[flat], leaves, leaf.astype(np.int32)[np.concatenate((flat[:1] * 0, flat[:-1]))]


def chunks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list, list]]:
    """With doc_id and held_out of the chunk's documents, where the batches have them."""
    chunk, ids, held = Chunk(), [], []
    for batch in it:
        own = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in ("doc_id", "held_out")]
        for text, doc_id, out in zip(batch.column("text"), *own, strict=True):
            chunk.add(text.as_py())
            ids.append(doc_id)
            held.append(out)
            if chunk.bytes >= CHUNK_BYTES:
                yield chunk, ids, held
                chunk, ids, held = Chunk(), [], []
    if ids:
        yield chunk, ids, held


def counted(buckets: int):  # noqa: ANN201
    """Each chunk's counts of words by context, a row a bucket."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _ in chunks(it):
            hashes, begins, places, leaves, leaf = chunk.arranged(buckets)
            keys, n = np.unique(places.astype(np.int64) * len(leaves) + leaf, return_counts=True)
            words, rows = keys // len(leaves), []
            for b in range(buckets):
                lo, hi = begins[b], begins[b + 1]
                if lo < hi:
                    at = slice(*np.searchsorted(words, (lo, hi)))
                    per = np.bincount(words[at] - lo, minlength=hi - lo)
                    own, place = np.unique(keys[at] % len(leaves), return_inverse=True)
                    rows.append((b, ascending(hashes[lo:hi]), counts(per), ascending(leaves[own]), planes(place), counts(n[at])))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], names=["bucket", "words", "per", "leaves", "contexts", "n"])

    return batches


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(n, t) at [n, t]: seatings of n customers at t tables, each of weight the product of its choices."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0
    for n in range(1, most):
        t = np.arange(1, n + 1)
        s[n + 1, 1 : n + 1] = s[n, 1 : n + 1] + np.log(n - d * t)
        s[n + 1, 1 : n + 2] = np.logaddexp(s[n + 1, 1 : n + 2], np.concatenate(([-np.inf], s[n, 1 : n + 1])))
    return s


def seated(n: np.ndarray, weight: np.ndarray, d: float, p: np.ndarray, rng: np.random.Generator, stirling: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with n customers, in restaurants whose other tables give a new one `weight` * p."""
    out, few = np.minimum(n, 1), np.minimum(n, EXACT)
    several = np.flatnonzero(few > 1)
    several = several[np.argsort(few[several], kind="stable")]
    for where in np.split(several, np.flatnonzero(np.diff(few[several])) + 1) if len(several) else ():
        size = int(few[where[0]])
        most = max(1, 2_000_000 // size)
        for at in (where[k : k + most] for k in range(0, len(where), most)):
            j = np.arange(size)
            logs = np.cumsum(np.log(weight[at, None] + d * j) + np.log(p[at, None]), axis=1) + stirling[size, 1 : size + 1]
            share = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (share < rng.random((len(at), 1)) * share[:, -1:]).sum(axis=1)
    i, at = EXACT, np.flatnonzero(n > EXACT)
    while len(at):
        block = np.minimum(max(1, int(i * GROWTH)), n[at] - i)
        new = (weight[at] + d * out[at]) * p[at]
        out[at] += rng.binomial(block, new / (new + i - d * out[at]))
        i += max(1, int(i * GROWTH))
        at = at[n[at] > i]
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series from 8 on."""
    x, less = np.asarray(x, float).copy(), 0.0
    for _ in range(8):
        small = x < 8
        less = less + np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x - less


def tables_evidence(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(DISCOUNTS, STRENGTHS): the log probability of restaurants' numbers of tables and customers, but for the dishes' own parts."""
    d, s = DISCOUNTS[:, None, None], STRENGTHS[None, :, None]
    c, many_c = np.unique(customers[customers > 0], return_counts=True)
    t, many_t = np.unique(tables[customers > 0], return_counts=True)
    new = (t - 1) * np.log(d) + log_gamma(s / d + t) - log_gamma(s / d + 1)
    return (new * many_t).sum(axis=-1) - ((log_gamma(s + c) - log_gamma(s + 1)) * many_c).sum(axis=-1)


@cache
def _stirlings() -> np.ndarray:
    """(DISCOUNTS, customers, tables)"""
    return np.stack([log_stirling(d) for d in DISCOUNTS])


def peak(logs: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> float:
    """A draw from a density whose logs at equally spaced places are given: of the parabola through the highest and its neighbours."""
    k = int(np.clip(logs.argmax(), 1, len(at) - 2))
    left, middle, right = logs[k - 1 : k + 2]
    bend, step = left - 2 * middle + right, at[1] - at[0]
    if bend >= -1e-9:  # no peak inside: the grid's best
        return float(at[logs.argmax()])
    return float(np.clip(at[k] + step * (left - right) / (2 * bend) + step * rng.standard_normal() / np.sqrt(-bend), at[0], at[-1]))


@dataclass
class Settings:
    """What all buckets share: discounts and strengths of leaf, parent and root restaurants and the totals of the latter two."""

    discounts: tuple[float, float, float]
    strengths: tuple[float, float, float]
    totals: np.ndarray

    @classmethod
    def of(cls, totals: np.ndarray) -> Settings:
        return cls(cls._estimates(totals), (STRENGTH,) * 3, totals)

    @staticmethod
    def _estimates(totals: np.ndarray) -> tuple[float, ...]:
        ones, twos = totals[ONES:DISH_EVIDENCE:2], totals[ONES + 1 : DISH_EVIDENCE : 2]
        return tuple(float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95)) for a, b in zip(ones, twos, strict=True))

    def renewed(self, totals: np.ndarray) -> Settings:
        return Settings(self.discounts, self.strengths, totals)

    def resampled(self, evidence: np.ndarray, rng: np.random.Generator) -> Settings:
        """With discounts and strengths drawn anew; evidence: tables_evidence of the contexts whose dishes' is in the totals."""
        if not self.tokens():
            return self
        logs, places = evidence + self.totals[DISH_EVIDENCE:, None], np.log(STRENGTHS)
        i, _ = np.unravel_index(logs.argmax(), logs.shape)
        strength = peak(logs[i], places, rng)
        at = min(int((strength - places[0]) / (places[1] - places[0])), len(places) - 2)
        share = (strength - places[at]) / (places[1] - places[0])
        discount = peak((1 - share) * logs[:, at] + share * logs[:, at + 1], DISCOUNTS, rng)
        strengths = [strength]
        others = self._estimates(self.totals)[1:]
        for level, d in zip((PARENT, ROOT), others, strict=True):
            own = tables_evidence(self.customers(level).astype(np.int64), self.tables(level).astype(np.int64))
            strengths.append(peak(own[int(np.abs(DISCOUNTS - d).argmin())], places, rng))
        return Settings((discount, *others), tuple(float(np.exp(s)) for s in strengths), self.totals)

    def customers(self, level: int) -> np.ndarray:
        return self.totals[level : level + {PARENT: PARENTS, ROOT: 1}[level]]

    def tables(self, level: int) -> np.ndarray:
        size = {PARENT: PARENTS, ROOT: 1}[level]
        return self.totals[level + size : level + 2 * size]

    def tokens(self) -> int:
        return int(self.totals[TOKENS])

    def uniform(self) -> float:
        return 1 / (self.totals[DISHES] + 1)


class Seating:
    """A bucket's words, each word's customers by context, and their tables; and the totals of its contexts' restaurants."""

    def __init__(self, words: np.ndarray, per: np.ndarray, contexts: np.ndarray | None, n: np.ndarray, ranked: tuple[np.ndarray, np.ndarray] | None = None):
        self.words, self.per, self.n = words, per, n
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), per)
        self.leaves, leaf = ranked or np.unique(contexts.astype(np.uint64), return_inverse=True)
        self.leaf = leaf.astype(np.int32)
        group = self.word.astype(np.int64) * PARENTS + parents_of(self.leaves)[self.leaf]
        new = np.diff(group, prepend=-1) != 0
        self.begins, self.group = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
        self.group_key = group[self.begins]
        self.group_word, self.group_parent = self.group_key // PARENTS, self.group_key % PARENTS
        self.t1, self.t2, self.t3 = np.ones(len(n), np.int32), np.ones(len(self.begins), np.int64), np.ones(len(words), np.int64)
        self.leaf_customers, self.leaf_tables = self.by_leaf(n), self.by_leaf(self.t1)

    @property
    def contexts(self) -> np.ndarray:
        return self.leaves[self.leaf]

    @cached_property
    def key(self) -> np.ndarray:
        return self.word.astype(np.int64) * len(self.leaves) + self.leaf

    def by_leaf(self, x: np.ndarray) -> np.ndarray:
        """Sums over the bucket's own words, by context."""
        return np.bincount(self.leaf, x, len(self.leaves)).astype(np.int64)

    def take(self, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Seating:
        self.t1, self.t2, self.t3 = tables
        return self

    @property
    def c2(self) -> np.ndarray:
        return np.add.reduceat(self.t1, self.begins, dtype=np.int64) if len(self.begins) else self.t1.astype(np.int64)

    @property
    def c3(self) -> np.ndarray:
        return np.bincount(self.group_word, self.t2, len(self.words)).astype(np.int64)

    def totals(self) -> np.ndarray:
        out = np.zeros(TOTALS)
        c2, c3 = self.c2, self.c3
        for level, where, size, c, t in ((PARENT, self.group_parent, PARENTS, c2, self.t2), (ROOT, np.zeros(len(c3), np.int64), 1, c3, self.t3)):
            out[level : level + size] = np.bincount(where, c, size)
            out[level + size : level + 2 * size] = np.bincount(where, t, size)
        out[TOKENS], out[DISHES] = self.n.sum(), len(self.words)
        out[ONES:DISH_EVIDENCE] = [np.count_nonzero(c == k) for c in (self.n, c2, c3) for k in (1, 2)]
        return out

    def dish_evidence(self, whole: np.ndarray) -> np.ndarray:
        """By discount: the log number of seatings of the dishes in the contexts (by place) that are `whole`: none there has more than EXACT customers."""
        at = np.flatnonzero((self.n > 1) & whole[self.leaf])
        pairs, many = np.unique(self.n[at] * (EXACT + 1) + self.t1[at], return_counts=True)
        return _stirlings()[:, pairs // (EXACT + 1), pairs % (EXACT + 1)] @ many if len(pairs) else np.zeros(len(DISCOUNTS))

    def root(self, s: Settings, c3: np.ndarray, t3: np.ndarray) -> np.ndarray:
        d, strength = s.discounts[2], s.strengths[2]
        return (c3 - d * t3 + (strength + d * s.tables(ROOT)[0]) * s.uniform()) / (strength + s.customers(ROOT)[0])

    def parent(self, s: Settings, which: np.ndarray, c2: np.ndarray, t2: np.ndarray, root: np.ndarray) -> np.ndarray:
        d, strength = s.discounts[1], s.strengths[1]
        return (c2 - d * t2 + (strength + d * s.tables(PARENT)[which]) * root) / (strength + s.customers(PARENT)[which])

    def sweep(self, s: Settings, rng: np.random.Generator, stirling: list[np.ndarray]) -> None:
        """Draws all numbers of tables anew, from the leaves to the root, each without its own part in what is above."""
        (d1, d2, d3), (s1, s2, s3) = s.discounts, s.strengths
        at = np.flatnonzero(self.n > 1)
        g = self.group[at]
        c3, c2 = self.c3, self.c2
        own = c2[g] - self.t1[at]
        above = self.parent(s, self.group_parent[g], own, np.minimum(self.t2[g], own), self.root(s, c3, self.t3)[self.word[at]])
        weight = s1 + d1 * np.maximum(self.leaf_tables[self.leaf[at]] - self.t1[at], 0)
        self.t1[at] = seated(self.n[at], weight, d1, above, rng, stirling[0])
        c2 = self.c2
        own = c3[self.group_word] - self.t2
        above = self.root(s, own, np.minimum(self.t3[self.group_word], own))
        self.t2 = seated(c2, s2 + d2 * np.maximum(s.tables(PARENT)[self.group_parent] - self.t2, 0), d2, above, rng, stirling[1])
        self.t3 = seated(self.c3, s3 + d3 * np.maximum(s.tables(ROOT)[0] - self.t3, 0), d3, np.full(len(self.words), s.uniform()), rng, stirling[2])

    def find(self, word: np.ndarray, contexts: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of the group and of the pair of words, by place and -1 for a word not seen, and contexts, whose places are `leaf`; -1 where there is none."""
        group = np.where(word >= 0, found(self.group_key, word * PARENTS + parents_of(contexts)), -1)
        return word, group, np.where((word >= 0) & (leaf >= 0), found(self.key, word * len(self.leaves) + leaf), -1), leaf

    def predictor(self, s: Settings):  # noqa: ANN201
        """Of found places and contexts: the parents' probabilities and the contexts' own with the seating as it is now."""
        (d1, d2, _), (s1, s2, _) = s.discounts, s.strengths
        t1, group = self.t1, np.append(self.c2 - d2 * self.t2, 0)
        root = np.append(self.root(s, self.c3, self.t3), self.root(s, np.zeros(1), np.zeros(1)))
        above_leaf, above_group = s1 + d1 * np.append(self.leaf_tables, 0), s2 + d2 * s.tables(PARENT)
        customers = s1 + np.append(self.leaf_customers, 0)

        def predicted(places: tuple[np.ndarray, ...], contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            word, at_group, at_pair, leaf = places
            parents = parents_of(contexts)
            above = (group[at_group] + above_group[parents] * root[word]) / (s2 + s.customers(PARENT)[parents])
            own = np.where(at_pair >= 0, self.n[at_pair] - d1 * t1[at_pair], 0) if len(t1) else 0
            return above, (own + above_leaf[leaf] * above) / customers[leaf]

        return predicted


def merged(table: pa.Table) -> Seating:
    """One bucket's chunks, summed."""
    parts = [(unascending(w), uncounts(p), unascending(u)[unplanes(c)], uncounts(n)) for w, p, u, c, n in zip(*(table.column(x).to_pylist() for x in ("words", "per", "leaves", "contexts", "n")), strict=True)]
    words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    leaves, leaf = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    keys = np.repeat(place, np.concatenate([p[1] for p in parts])) * len(leaves) + leaf
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([p[3] for p in parts])[order]
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    n, keys = np.add.reduceat(n, begins), keys[begins]
    leaf = keys % len(leaves)
    return Seating(words, np.bincount(keys // len(leaves), minlength=len(words)), None, n, (leaves, leaf))


STATE = "bucket int, words binary, per binary, leaves binary, contexts binary, n binary, tables array<binary>, totals array<array<double>>"
_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("words", "per", "leaves", "contexts", "n")), ("tables", pa.list_(pa.binary())), ("totals", pa.list_(pa.list_(pa.float64())))])


def _state(bucket: int, s: Seating, samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], totals: list[np.ndarray]) -> dict:
    return {"bucket": bucket, "words": ascending(s.words), "per": counts(s.per), "leaves": ascending(s.leaves), "contexts": planes(s.leaf), "n": counts(s.n), "tables": [counts(t) for sample in samples for t in sample], "totals": [t.tolist() for t in totals]}


def _seating(row: dict) -> tuple[Seating, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    leaves, leaf = unascending(row["leaves"]), unplanes(row["contexts"])
    s = Seating(unascending(row["words"]), uncounts(row["per"]), None, uncounts(row["n"]), (leaves, leaf))
    tables = [uncounts(t).astype(np.int32 if k % 3 == 0 else np.int64) for k, t in enumerate(row["tables"])]
    return s, [tuple(tables[k : k + 3]) for k in range(0, len(tables), 3)]


def first_seating(key: tuple, table: pa.Table) -> pa.Table:
    s = merged(table)
    return pa.Table.from_pylist([_state(key[0].as_py(), s, [(s.t1, s.t2, s.t3)], [s.totals()])], schema=_ARROW)


#: sums: customers, each sample's tables, dishes of more than EXACT customers. evidence: of the last sample, where these are none.
SHARDS = "shard int, bucket int, leaves binary, sums array<binary>, evidence array<double>"
_SHARDS = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("leaves", pa.binary()), ("sums", pa.list_(pa.binary())), ("evidence", pa.list_(pa.float64()))])
#: In place of a bucket: the whole of a shard.
WHOLE = -1


def sent_to_shards(shards: int):  # noqa: ANN201
    """Each bucket's sums by context, customers and each sample's tables, a row a shard."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                s, samples = _seating(row)
                sums, shard = [s.by_leaf(s.n), *(s.by_leaf(t[0]) for t in samples), s.by_leaf(s.n > EXACT)], shards_of(s.leaves, shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = [{"shard": b, "bucket": row["bucket"], "leaves": ascending(s.leaves[order[lo:hi]]), "sums": [counts(x[order[lo:hi]]) for x in sums]} for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
                yield pa.RecordBatch.from_pylist(rows, schema=_SHARDS)

    return batches


def shard_totals(key: tuple, table: pa.Table) -> pa.Table:
    """A shard's whole totals, and of these to each bucket those of its contexts, in the order they came in."""
    rows = table.to_pylist()
    sent = [unascending(r["leaves"]) for r in rows]
    leaves, place = np.unique(np.concatenate(sent), return_inverse=True)
    sums = [np.bincount(place, np.concatenate([uncounts(r["sums"][k]) for r in rows])).astype(np.int64) for k in range(len(rows[0]["sums"]))]
    exact = sums[-1] == 0
    evidence = tables_evidence(sums[0][exact], sums[-2][exact]).ravel().tolist()
    out, at = [{"shard": key[0].as_py(), "bucket": WHOLE, "leaves": ascending(leaves), "sums": [counts(x) for x in sums], "evidence": evidence}], 0
    for r, size in zip(rows, map(len, sent), strict=True):
        out.append({"shard": key[0].as_py(), "bucket": r["bucket"], "leaves": None, "sums": [counts(x[place[at : at + size]]) for x in sums]})
        at += size
    return pa.Table.from_pylist(out, schema=_SHARDS)


def freed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that newer ones stand in for, and lets Spark's cleaner remove the shuffles that made them."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def restaurants(state: DataFrame, shards: int) -> DataFrame:
    """The totals of the contexts' restaurants, by shard and bucket."""
    return written(state.mapInArrow(sent_to_shards(shards), SHARDS).groupBy("shard").applyInArrow(shard_totals, SHARDS), "restaurants")


def own_totals(s: Seating, rows: list[dict], shards: int, name: str = "sums") -> list[np.ndarray]:
    """The totals of a bucket's contexts, in order of context, from what the shards sent it."""
    sums = [np.concatenate(x) for x in zip(*([uncounts(x) for x in r[name]] for r in sorted(rows, key=lambda r: r["shard"])), strict=True)]
    order = np.argsort(shards_of(s.leaves, shards), kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return [x[back] for x in sums]


def swept(settings, plan: tuple[int, ...], stage: int, shards: int):  # noqa: ANN001, ANN201
    """Of each bucket's last sample: a new sample after each number of sweeps in plan."""

    def group(key: tuple, state: pa.Table, totals: pa.Table) -> pa.Table:
        row, shared = state.to_pylist()[0], settings.value
        s, old = _seating(row)
        sums = own_totals(s, totals.to_pylist(), shards)
        s.take(old[-1])
        s.leaf_customers, s.leaf_tables = sums[0], sums[-2]
        stirling = [log_stirling(d) for d in shared.discounts]
        rng, samples, new = np.random.default_rng((SEED, stage, row["bucket"])), [], []
        for sweeps in plan:
            for _ in range(sweeps):
                s.sweep(shared, rng, stirling)
            samples.append((s.t1.copy(), s.t2, s.t3))
            new.append(s.totals())
            new[-1][DISH_EVIDENCE:] = s.dish_evidence(sums[-1] == 0)
        return pa.Table.from_pylist([_state(row["bucket"], s, samples, new)], schema=_ARROW)

    return group


def _evidence(totals: DataFrame) -> np.ndarray:
    """tables_evidence of all shards."""
    rows = totals.where(F.col("bucket") == WHOLE).select(F.posexplode("evidence").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(DISCOUNTS) * len(STRENGTHS))
    for r in rows:
        out[r["at"]] = r.x
    return out.reshape(len(DISCOUNTS), len(STRENGTHS))


def _totals(state: DataFrame, samples: int) -> list[np.ndarray]:
    """Each sample's totals, summed over buckets."""
    rows = state.select(F.posexplode("totals").alias("sample", "own")).select("sample", F.posexplode("own").alias("at", "x")).groupBy("sample", "at").agg(F.sum("x").alias("x")).collect()
    out = [np.zeros(TOTALS) for _ in range(samples)]
    for r in rows:
        out[r.sample][r["at"]] = r.x
    return out


@dataclass
class Model:
    """The dealt-out seatings, what they share in each sample, the number of buckets, and the contexts' totals by shard."""

    state: DataFrame
    samples: list[Settings]
    buckets: int
    restaurants: DataFrame


def fitted(docs: DataFrame) -> Model:
    """Of all texts of docs."""
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(64)).alias("n")).first().n or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    counts = docs.select("text").mapInArrow(counted(buckets), "bucket int, words binary, per binary, leaves binary, contexts binary, n binary")
    state = written(counts.groupBy("bucket").applyInArrow(first_seating, STATE), "seating")
    settings = Settings.of(_totals(state, 1)[0])
    share = docs.sparkSession.sparkContext.broadcast
    freed(docs.sparkSession)

    def passed(plan: tuple[int, ...], stage: int, totals: DataFrame) -> DataFrame:
        own = totals.where(F.col("bucket") != WHOLE).groupBy("bucket")
        return written(state.groupBy("bucket").cogroup(own).applyInArrow(swept(share(settings), plan, stage, buckets), STATE), "seating")

    for stage, plan in ((1, (BURN_IN,)), (2, SAMPLES)):
        totals, old = restaurants(state, buckets), state
        if stage > 1:
            settings = settings.resampled(_evidence(totals), np.random.default_rng((SEED, stage)))
        state = passed(plan, stage, totals)
        freed(docs.sparkSession, old, totals)
        samples = [settings.renewed(t) for t in _totals(state, len(plan))]
        settings = samples[-1]
    last = restaurants(state, buckets)
    samples[-1] = settings.resampled(_evidence(last), np.random.default_rng((SEED, 3)))
    freed(docs.sparkSession)
    return Model(state, samples, buckets, last)


def _averaged(row: dict | None, samples: list[Settings], totals: list[dict] = (), shards: int = 1, name: str = "sums"):  # noqa: ANN202
    """A bucket's seating and its function of (word, contexts): the mean of the samples' probabilities, with each sample's parents' probabilities where places of contexts are given.

    totals: what the shards sent the bucket.
    """
    if row is None:
        s, tables, sums = Seating(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3), [(np.zeros(0, np.int64),) * 3] * len(samples), [np.zeros(0, np.int64)] * (1 + len(samples))
    else:
        s, tables = _seating(row)
        sums = own_totals(s, totals, shards, name)[:-1]

    predictors = []
    s.leaf_customers = sums[0]
    for t, own, x in zip(tables, sums[1:], samples, strict=True):
        s.leaf_tables = own
        predictors.append(s.take(t).predictor(x))

    def probability(word: np.ndarray, contexts: np.ndarray, leaf: np.ndarray | None = None):  # noqa: ANN202
        contexts = contexts.astype(np.uint64)
        places = s.find(word, contexts, found(s.leaves, contexts) if leaf is None else leaf)
        both = [p(places, contexts) for p in predictors]
        mean = sum(p for _, p in both) / len(samples)
        return mean if leaf is None else (mean, [above for above, _ in both])

    return s, probability


def _customers(s: Seating) -> np.ndarray:
    return np.bincount(s.word, s.n, len(s.words))


def head(model: Model, share: float = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of pairs that are `share` of all tokens or more, at most 1 / share; their words' counts and their probabilities."""
    spark = model.state.sparkSession
    sent = spark.sparkContext.broadcast(model.samples)

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = max(share * sent.value[0].tokens(), 1)
        for batch in it:
            for k in range(batch.num_rows):
                s, tables = _seating(batch.slice(k, 1).to_pylist()[0])
                common = np.flatnonzero(s.n >= least)
                word, contexts, parts = s.word[common].astype(np.int64), s.leaves[s.leaf[common]], []
                for t, x in zip(tables, sent.value, strict=True):
                    above, _ = s.take(t).predictor(x)(s.find(word, contexts, s.leaf[common].astype(np.int64)), contexts)
                    parts += [above, s.n[common] - x.discounts[0] * t[0][common]]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (pair_keys(s.words[word], contexts), contexts, _customers(s)[word], np.array(parts, float))], names=["keys", "contexts", "n", "parts"])

    rows = model.state.mapInArrow(pairs, "keys binary, contexts binary, n binary, parts binary").collect()
    keys, contexts, n = (np.concatenate([np.zeros(0, t), *(np.frombuffer(r[c], t) for r in rows)]) for c, t in (("keys", np.uint64), ("contexts", np.uint64), ("n", float)))
    parts = np.concatenate([np.zeros((2 * len(model.samples), 0)), *(np.frombuffer(r.parts).reshape(2 * len(model.samples), -1) for r in rows)], axis=1)
    wanted = spark.sparkContext.broadcast(np.unique(contexts))

    def totals(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                leaves = unascending(row["leaves"])
                at = found(leaves, wanted.value)
                at, own = at[at >= 0], wanted.value[at >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()]), pa.array([np.array([uncounts(x)[at] for x in row["sums"][:-1]], float).tobytes()])], names=["contexts", "sums"])

    rows = model.restaurants.where(F.col("bucket") == WHOLE).select("leaves", "sums").mapInArrow(totals, "contexts binary, sums binary").collect()
    known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.contexts, np.uint64) for r in rows)])
    sums = np.concatenate([np.zeros((1 + len(model.samples), 0)), *(np.frombuffer(r.sums).reshape(1 + len(model.samples), -1) for r in rows)], axis=1)
    by_context = np.argsort(known)
    at = by_context[found(known[by_context], contexts)] if len(contexts) else np.zeros(0, np.int64)
    p = np.zeros(len(keys))
    for k, x in enumerate(model.samples):
        d, strength = x.discounts[0], x.strengths[0]
        p += (parts[2 * k + 1] + (strength + d * sums[1 + k, at]) * parts[2 * k]) / (strength + sums[0, at]) / len(model.samples)
    order = np.argsort(keys)
    return keys[order], n[order], p[order]


#: per: pairs of each word; contexts: of each pair, among leaves; pair_tokens: tokens of each pair, whose documents follow each other in token_doc.
PARTS = "chunk long, bucket int, words binary, per binary, leaves binary, contexts binary, pair_tokens binary, token_doc binary, doc_id binary, has_id binary, held_out binary, n_tokens binary, known binary, base binary, score binary, shard int, pair_chunk binary, above array<binary>"
_PARTS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), *((x.split()[0], pa.binary()) for x in PARTS.split(", ")[2:-3]), ("shard", pa.int32()), ("pair_chunk", pa.binary()), ("above", pa.list_(pa.binary()))])


def sent_to_buckets(shared, buckets: int):  # noqa: ANN001, ANN201
    """Each chunk's documents with the sums over common pairs, and the other pairs by bucket."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, common_n, common_p = shared.value
        for k, (chunk, doc_ids, held) in enumerate(chunks(it)):
            number = TaskContext.get().partitionId() << 32 | k
            hashes, begins, places, leaves, leaf = chunk.arranged(buckets)
            doc = np.repeat(np.arange(len(chunk.sizes), dtype=np.int32), chunk.sizes)
            mine = np.concatenate([found(common, pair_keys(hashes[places[at : at + 65536]], leaves[leaf[at : at + 65536]])).astype(np.int32) for at in range(0, len(places), 65536)])
            here = mine >= 0
            sums = [np.bincount(doc[here], w, len(chunk.sizes)) for w in (np.ones(here.sum()), np.log10(common_n[mine[here]] + 0.1), np.log10(common_p[mine[here]]))]
            ids = np.array([i or 0 for i in doc_ids], np.int64)
            yield pa.RecordBatch.from_pylist([{
                "chunk": number, "bucket": number % 1009 % buckets, "doc_id": ids.tobytes(), "has_id": np.array([i is not None for i in doc_ids], np.uint8).tobytes(), "held_out": np.array(held, np.uint8).tobytes(),
                "n_tokens": np.array(chunk.sizes, np.int64).tobytes(), "known": sums[0].astype(np.int64).tobytes(), "base": sums[1].tobytes(), "score": sums[2].tobytes(),
            }], schema=_PARTS)
            rest = np.flatnonzero(~here).astype(np.int32)
            del mine, here
            keys = places[rest].astype(np.int64) * len(leaves) + leaf[rest]
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], doc[rest[order]]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, tokens = keys[first], np.diff(first, append=len(keys))
            first, words = np.append(first, len(docs)), keys // len(leaves)
            cuts = np.searchsorted(words, begins)
            for b in range(buckets):
                at = slice(cuts[b], cuts[b + 1])
                if at.start < at.stop:
                    own, per = np.unique(words[at], return_counts=True)
                    seen, context = np.unique(keys[at] % len(leaves), return_inverse=True)
                    yield pa.RecordBatch.from_pylist([{"chunk": number, "bucket": b, "words": ascending(hashes[own]), "per": counts(per), "leaves": ascending(leaves[seen]), "contexts": planes(context), "pair_tokens": counts(tokens[at]), "token_doc": planes(docs[first[at.start] : first[at.stop]])}], schema=_PARTS)

    return batches


def scored_in_bucket(shared, shards: int):  # noqa: ANN001, ANN201
    """Documents' parts of sums over one bucket's words; rows of documents go through. Tokens whose context the bucket doesn't know get a row a shard, with the parents' probabilities."""

    def group(key: tuple, state: pa.Table, rows: pa.Table) -> pa.Table:
        sent = pa.compute.is_valid(rows.column("above"))
        totals, rows = rows.filter(sent).select(["shard", "above"]).to_pylist(), rows.filter(pa.compute.invert(sent))
        s, probability = _averaged(state.to_pylist()[0] if state.num_rows else None, shared.value, totals, shards, "above")
        del totals
        n, out, strange = np.append(_customers(s), 0), [], []
        for k in range(rows.num_rows):
            row = rows.slice(k, 1).to_pylist()[0]
            if row["words"] is None:
                out.append(row)
                continue
            place, leaves, at = found(s.words, unascending(row["words"])), unascending(row["leaves"]), unplanes(row["contexts"])
            local, contexts, leaf = np.repeat(place, uncounts(row["per"])), leaves[at], found(s.leaves, leaves)[at]
            tokens, doc = uncounts(row["pair_tokens"]), unplanes(row["token_doc"])
            c, (p, above) = n[local], probability(local, contexts, leaf)
            sums = [np.bincount(doc, np.repeat(w, tokens)) for w in (c > 0, np.log10(c + 0.1), np.where(leaf >= 0, np.log10(p), 0))]
            docs = np.flatnonzero(np.bincount(doc))
            out.append({"chunk": row["chunk"], "bucket": row["bucket"], "token_doc": planes(docs), "known": counts(sums[0][docs]), "base": sums[1][docs].tobytes(), "score": sums[2][docs].tobytes()})
            at = np.flatnonzero(leaf < 0)
            strange.append((contexts[at], np.full(len(at), row["chunk"]), tokens[at], doc[np.repeat(leaf < 0, tokens)], *(a[at] for a in above)))
        if strange:
            contexts, chunk, tokens, doc, *above = (np.concatenate(x) for x in zip(*strange, strict=True))
            shard = shards_of(contexts, shards)
            token_shard = np.repeat(shard, tokens)
            for b in np.unique(shard).tolist():
                at = shard == b
                out.append({"bucket": key[0].as_py(), "shard": b, "leaves": contexts[at].tobytes(), "pair_chunk": planes(chunk[at], "<u8"), "pair_tokens": counts(tokens[at]), "token_doc": planes(doc[token_shard == b]), "above": [a[at].tobytes() for a in above]})
        return pa.Table.from_pylist(out, schema=_PARTS)

    return group


def scored_in_shard(shared):  # noqa: ANN001, ANN201
    """Documents' parts of sums over pairs whose context's bucket is another: nothing is known of the pair."""

    def group(key: tuple, totals: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _PARTS.empty_table()
        whole = totals.to_pylist()[0] if totals.num_rows else {"leaves": b"", "sums": [counts(np.zeros(0, np.int64))] * (2 + len(shared.value))}
        leaves, (customers, *tables) = unascending(whole["leaves"]), [np.append(uncounts(x), 0) for x in whole["sums"][:-1]]
        rows = sorted(rows.to_pylist(), key=lambda r: r["bucket"])
        contexts = np.concatenate([np.frombuffer(r["leaves"], np.uint64) for r in rows])
        chunk, tokens, doc = (np.concatenate([f(r[c]) for r in rows]) for c, f in (("pair_chunk", lambda x: unplanes(x, "<u8")), ("pair_tokens", uncounts), ("token_doc", unplanes)))
        at, above = found(leaves, contexts), [np.concatenate([np.frombuffer(r["above"][k]) for r in rows]) for k in range(len(tables))]
        p = sum((s.strengths[0] + s.discounts[0] * t[at]) * a / (s.strengths[0] + customers[at]) for s, t, a in zip(shared.value, tables, above, strict=True)) / len(tables)
        logs, chunk = np.repeat(np.log10(p), tokens), np.repeat(chunk, tokens)
        out, order = [], np.argsort(chunk, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
            docs, place = np.unique(doc[part], return_inverse=True)
            out.append({"chunk": int(chunk[part[0]]), "bucket": -1 - key[0].as_py(), "token_doc": planes(docs), "known": counts(np.zeros(len(docs))), "base": np.zeros(len(docs)).tobytes(), "score": np.bincount(place, logs[part]).tobytes()})
        return pa.Table.from_pylist(out, schema=_PARTS)

    return group


def summed(shared):  # noqa: ANN001, ANN201
    """A chunk's documents with their whole sums."""

    def group(key: tuple, rows: pa.Table) -> pa.Table:
        tokens, uniform = shared.value
        rows = rows.to_pylist()
        docs = next(r for r in rows if r["doc_id"] is not None)
        ids, has, held = (np.frombuffer(docs[c], t) for c, t in (("doc_id", np.int64), ("has_id", np.uint8), ("held_out", np.uint8)))
        n, known, base, score = (np.frombuffer(docs[c], t).copy() for c, t in (("n_tokens", np.int64), ("known", np.int64), ("base", float), ("score", float)))
        for r in sorted((r for r in rows if r["doc_id"] is None), key=lambda r: r["bucket"]):
            at = unplanes(r["token_doc"])
            known[at] += uncounts(r["known"])
            base[at] += np.frombuffer(r["base"])
            score[at] += np.frombuffer(r["score"])
        base -= n * np.log10(tokens + 0.1 / uniform)
        held = pa.array(held == 1)
        return pa.table({"doc_id": pa.array(ids, mask=has == 0), "held_out": held, "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), tokens), "base_score": base, "score": score})

    return group


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, held_out) with n_tokens, n_known, train_tokens, base_score and score in place of text."""
    share = docs.sparkSession.sparkContext.broadcast
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(sent_to_buckets(share(head(model)), model.buckets), PARTS)
    samples = share(model.samples)
    totals = model.restaurants.where(F.col("bucket") != WHOLE).select("bucket", "shard", F.col("sums").alias("above"))
    parts = parts.unionByName(totals, allowMissingColumns=True)
    back = written(model.state.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(scored_in_bucket(samples, model.buckets), PARTS), "scores")
    whole, strange = model.restaurants.where(F.col("bucket") == WHOLE), back.where("shard IS NOT NULL")
    back = back.where("shard IS NULL").unionByName(whole.groupBy("shard").cogroup(strange.groupBy("shard")).applyInArrow(scored_in_shard(samples), PARTS))
    numbers = share((model.samples[0].tokens(), model.samples[0].uniform()))
    return back.groupBy("chunk").applyInArrow(summed(numbers), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
