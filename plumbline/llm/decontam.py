"""Benchmark decontamination with a suffix automaton over the words of all test items.

The automaton accepts exactly the word sequences that occur within one item. Documents stream through it word by
word; wherever the longest match ending at a word reaches `window` words, those words are hit, and so is each
occurrence of a whole item shorter than `window`. Only runs of benchmark words that are long enough enter it.

It is grown on the driver and sent as flat arrays, about 50 bytes a benchmark word; a benchmark of more than
AUTOMATON_WORDS words takes a pass over the documents for each so many.

Defined results: null, empty and wordless texts have no words and no hits; items without words never occur; items
with one id count once; an item without id matches but isn't named; repeated documents each get their row; an empty
benchmark hits nothing. Ties don't arise: a word is hit or not. Words are bytes of UTF-8, so a text of any length costs
memory in proportion to itself only.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, tidy, written

#: Bytes of words to themselves, A-Z lower-cased; of all others to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Benchmark words in one automaton: some 50 MB in each worker and 250 MB on the driver while it grows.
AUTOMATON_WORDS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORDS).split() if text else []


class _Growing:
    """States 0 (the root) and up. A state's steps are none, one as symbol << 32 | target, or a dict of several."""

    def __init__(self) -> None:
        self.steps: list[int | dict[int, int] | None] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def after(self, state: int, c: int) -> int:
        """The state that c leads to, 0 for none: no word leads to the root."""
        own = self.steps[state]
        if isinstance(own, dict):
            return own.get(c, 0)
        return own & 0xFFFFFFFF if own is not None and own >> 32 == c else 0

    def lead(self, state: int, c: int, to: int) -> None:
        own = self.steps[state]
        if isinstance(own, dict):
            own[c] = to
        elif own is None or own >> 32 == c:
            self.steps[state] = c << 32 | to
        else:
            self.steps[state] = {own >> 32: own & 0xFFFFFFFF, c: to}

    def new(self, length: int, link: int, steps: int | dict[int, int] | None = None) -> int:
        self.steps.append(dict(steps) if isinstance(steps, dict) else steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.steps) - 1

    def read(self, state: int, c: int) -> int:
        """The state of what was read, with c after it."""
        if to := self.after(state, c):
            return self._apart(state, c, to)
        new, at = self.new(self.length[state] + 1, 0), state
        while at >= 0 and not self.after(at, c):
            self.lead(at, c, new)
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._apart(at, c, self.after(at, c))
        return new

    def _apart(self, at: int, c: int, to: int) -> int:
        """The state of exactly what c after `at` reads: a twin of `to`, where that also holds longer sequences."""
        if self.length[to] == self.length[at] + 1:
            return to
        twin = self.new(self.length[at] + 1, self.link[to], self.steps[to])
        self.link[to] = twin
        while at >= 0 and self.after(at, c) == to:
            self.lead(at, c, twin)
            at = self.link[at]
        return twin


def _ragged(groups: list[list[int]]) -> tuple[array, array]:
    """Lists end to end, and where each begins."""
    return array("I", (x for g in groups for x in g)), array("I", accumulate((len(g) for g in groups), initial=0))


class Automaton:
    """Of a list of (item_id, words); scan() gives a mask of hit words and the items that occur."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocabulary, made = window, {}, _Growing()
        items = [x for x in items if x[1]]
        self.least = min((len(words) for _, words in items if len(words) < window), default=window)
        coded = [array("I", (self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)) for _, words in items]
        for words in coded:
            state = 0
            for c in words:
                state = made.read(state, c)
        self.names = [name for name, _ in items]
        self.link, self.length = made.link, made.length
        #: Of states of `window` words or more: the number of the one sequence of `window` words that ends theirs.
        self.gram = array("i", [-1]) * len(self.length)
        #: The nearest state, itself first and then by links, that a whole short item ends; and those states' items by length.
        self.short, self.whole = array("I", [0]) * len(self.length), defaultdict(lambda: defaultdict(list))
        owners = self._owners(coded, made)
        self.owners, self.owned_at = _ragged([sorted(owners[g]) for g in range(len(owners))])
        self._flatten(made)

    def _owners(self, coded: list[array], made: _Growing) -> dict[int, set[int]]:
        """Numbers sequences of `window` words and tells the items that have each; notes whole short items."""
        order, n = sorted(range(1, len(self.length)), key=self.length.__getitem__), 0
        for s in order:
            if self.length[s] >= self.window:
                if self.length[self.link[s]] >= self.window:
                    self.gram[s] = self.gram[self.link[s]]
                else:
                    self.gram[s], n = n, n + 1
        owners: dict[int, set[int]] = {g: set() for g in range(n)}
        for item, words in enumerate(coded):
            state = 0
            for at, c in enumerate(words, 1):
                state = made.after(state, c)
                if at >= self.window and self.names[item] is not None:
                    owners[self.gram[state]].add(item)
            if len(words) < self.window:
                self.whole[state][len(words)].append(item)
        self.whole = {s: dict(x) for s, x in self.whole.items()}
        if self.whole:
            for s in order:
                self.short[s] = s if s in self.whole else self.short[self.link[s]]
        return owners

    def _flatten(self, made: _Growing) -> None:
        steps = [sorted(x.items()) if isinstance(x, dict) else [] if x is None else [(x >> 32, x & 0xFFFFFFFF)] for x in made.steps]
        self.root = array("I", [0, *(to for _, to in steps[0])])  # every word follows the root
        steps[0] = []
        self.symbols, self.begins = _ragged([[c for c, _ in own] for own in steps])
        self.targets = array("I", (to for own in steps for _, to in own))

    def after(self, state: int, c: int) -> int:
        if not state:
            return self.root[c]
        lo, hi = self.begins[state], self.begins[state + 1]
        at = lo if hi - lo == 1 else bisect_left(self.symbols, c, lo, hi)
        return self.targets[at] if at < hi and self.symbols[at] == c else 0

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        if len(words) < self.least or not self.vocabulary:
            return None, set()
        after, link, length, gram = self.after, self.link, self.length, self.gram
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
        begins, ends = known[::2], known[1::2]
        long = ends - begins >= self.least
        mask, grams, items = None, set(), set()
        for begin, end in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            state = matched = 0
            for i, c in enumerate(ids[begin:end].tolist(), begin):
                while not (to := after(state, c)):
                    state = link[state]
                    matched = length[state]
                state, matched = to, matched + 1
                span = 0
                if matched >= self.window:
                    span = matched
                    grams.add(gram[state])
                at = self.short[state]
                while at:
                    for n, whole in self.whole[at].items():
                        if n <= matched:
                            span = max(span, n)
                            items.update(whole)
                    at = self.short[link[at]]
                if span:
                    mask = np.zeros(len(words), bool) if mask is None else mask
                    mask[i + 1 - span : i + 1] = True
        for g in grams:
            items.update(self.owners[self.owned_at[g] : self.owned_at[g + 1]])
        return mask, {self.names[k] for k in items} - {None}


def _shards(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in id order, as many at a time as one automaton takes; a single longer item makes its own."""
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where(F.col("text").isNotNull()).orderBy("i", "text").toLocalIterator():
        words = words_of(row.text)
        if held and n + len(words) > most:
            yield held
            held, n = [], 0
        held.append((row.i, words))
        n += len(words)
    yield held


def _marked(docs: DataFrame, scanner, hits: str, items: str, count: str, cut: bool) -> DataFrame:
    """docs with a packed mask of hit words, the items found and the number of words, added to what was found before.

    cut: also takes the hit words out of text; the mask tells their places in the text as it was.
    """
    more = hits in docs.columns
    schema = docs.schema if more else T.StructType([*docs.schema.fields, T.StructField(hits, T.BinaryType()), T.StructField(items, T.ArrayType(T.StringType())), T.StructField(count, T.LongType())])
    own_names = [f.name for f in schema.fields if f.name not in (hits, items, count)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = scanner.value
        for batch in it:
            masks, found, counts, texts = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                words = words_of(text)
                mask, got = use.scan(words)
                if more:
                    got |= set(batch.column(items)[k].as_py() or ())
                    if (old := batch.column(hits)[k].as_py()) is not None:
                        old = np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                        mask = old if mask is None else mask | old
                masks.append(None if mask is None else np.packbits(mask).tobytes())
                found.append(sorted(got))
                counts.append(len(words))
                if cut:
                    texts.append(text if mask is None else _cut(text, mask))
            own = [pa.array(texts, pa.string()) if cut and n == "text" else batch.column(n) for n in own_names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(masks, pa.binary()), pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.int64())], names=[*own_names, hits, items, count])

    return docs.mapInArrow(tidy(batches), T.StructType([*(schema[n] for n in own_names), *(schema[n] for n in (hits, items, count))]))


def marked(docs: DataFrame, benchmark: DataFrame, window: int = 13, most: int = AUTOMATON_WORDS, cut: bool = False) -> tuple[DataFrame, str, str, str]:
    """docs and the names of three new columns: packed mask of hit words, item ids found, number of words."""
    names, shards = [fresh(docs, n) for n in ("hit_words", "hit_items", "n_words")], _shards(benchmark, most)
    items, first = next(shards), True
    while items is not None:
        later = next(shards, None)
        docs = docs if first else written(docs, "marked")  # one automaton in memory at a time
        docs = _marked(docs, docs.sparkSession.sparkContext.broadcast(Automaton(items, window)), *names, cut and later is None)
        items, first = later, False
    return docs, *names


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row a document."""
    found, hits, items, count = marked(docs.select("doc_id", "text"), benchmark, window)
    n_hit = bits(F.col(hits))
    out = found.select("doc_id", F.col(count).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def bits(packed):
    """The number of set bits of a binary column, 0 for null."""
    nibbles = F.hex(packed)
    of = {n: "".join(d for d in "0123456789ABCDEF" if int(d, 16).bit_count() == n) for n in range(1, 5)}
    return sum((F.coalesce(F.length(F.translate(nibbles, "".join(d for d in "0123456789ABCDEF" if d not in of[n]), "")), F.lit(0)) * n for n in of), F.lit(0)).cast("long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, cut: bool = False) -> DataFrame:
    """docs, its columns as they were, without those of which `percent` or more of the words are hit.

    cut: also takes the hit spans, whatever their share, out of the documents that stay; from the first hit word's
    first byte to the last one's last.
    """
    found, hits, _, count = marked(docs, benchmark, window, cut=cut)
    n_hit = bits(F.col(hits))
    return found.where((n_hit == 0) | (n_hit * 100 < F.col(count) * percent)).select(*docs.columns)


def _cut(text: str, mask: np.ndarray) -> str:
    """text without each run of hit words, mask being of its words."""
    data = text.encode("utf-8", "replace")
    flat = np.frombuffer(data.translate(WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flat, [0])).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
    out, at = [], 0
    for first, last in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
        out.append(data[at : begins[first]])
        at = ends[last - 1]
    return b"".join([*out, data[at:]]).decode()
