"""Phrase collocations by language: phrases of up to `longest` words that occur far more often than their parts would
by chance.

All 1..longest-grams of a text's pieces become rows (lang, phrase, count), summed first within each block of text and then
by hash aggregation per language. A phrase seen `least` times has only words and pairs seen as often, so three passes leave
out what cannot come to that count, and nothing else: all words; pairs of such words; longer phrases of such pairs. What a
pass must know of the one before is a bitmap of fixed size (2**bits bits), which lets through too much where it fills up,
never too little, and is the same decision for all occurrences of a phrase, so counts are whole at every size.

Candidates then meet the counts of their first and last words for every cut, are scored in Decimal, leave where a longer
candidate is (nearly) as frequent, and are ranked by language. Phrase and longer candidate can be any words apart: the
phrase with one word more lies between the two and is at least as frequent as the longer one, so one-word extensions tell.

Defined results: a null text is empty; a null language is `und`; a text without words and an empty table give nothing.
Repeated rows count each time. Equal scores rank by count, then by the phrase's bytes. Texts of any length are read whole, a
block of words at a time. Other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK, checkpointed, tidy, written

LEAST, LONGEST, MOST, SHARE = 100, 5, 2000, 100
#: Size of the bitmaps of frequent words and pairs: 4 MB.
BITS = 25
#: Words that a task knows by number at a time.
KNOWN = 300_000
#: A-Z in lower case; what ends a piece as a full stop; a tab as a space.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("c", pa.int64())])


class _Words(dict):
    """Numbers of one language's words, from 1; 0 ends a piece. Also each word's hash, and whether the bitmap has it."""

    def __init__(self, lang: str, known: np.ndarray | None):
        super().__init__()
        self.lang, self.known = lang.encode(), known
        self.shift = 0 if known is None else _shift(known)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[b"."] = 0
        self.names, self.hashes, self.frequent = [b"."], [0], [False]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        h = word_hash(self.lang, word) if self.known is not None else 0
        self.names.append(word)
        self.hashes.append(h)
        self.frequent.append(self.known is None or bool(self.known[h >> self.shift + 3] >> (h >> self.shift & 7) & 1))
        return number


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of the words' hashes, unsigned."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xD1342543DE82EF95)
    return mixed ^ (mixed >> np.uint64(29))


def _shift(bitmap: np.ndarray) -> int:
    """By how many places a hash goes to the right to be one in a bitmap of so many bytes."""
    return 62 - len(bitmap).bit_length()


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(_shift(bitmap))
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words of texts and full stops where pieces end, a bounded number at a time."""
    data, at = b".".join(texts).translate(_FOLDED).replace(b".", b" . "), 0
    while at < len(data):
        end = len(data) if at + BLOCK >= len(data) else data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _repeats(x: np.ndarray, good: np.ndarray, old: int, sizes: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each phrase size: where each different phrase of x starts first, and how many end after the first `old` words.

    good: whether a word and the next may be part of a phrase. Phrases are told apart by that of a word less and their last word.
    """
    base, number = int(x.max(initial=0)) + 1, x
    for size in range(2, sizes[1] + 1):
        good = good if size == 2 else good[:-1] & good[1:]
        at = np.flatnonzero(good)
        if not len(at):
            return
        different, first, own = np.unique(number[at] * base + x[at + size - 1], return_index=True, return_inverse=True)
        number = np.zeros(len(good), np.int64)
        number[at] = own
        if size >= sizes[0]:
            counts = np.bincount(own[at > old - size], minlength=len(different))
            yield size, at[first[counts > 0]], counts[counts > 0]


def _phrases(sizes: tuple[int, int], known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """(lang, text) to (lang, phrase, c) for sizes from, to. known: broadcast bitmaps of words and of pairs, or None.

    With words (size one) comes a row without a phrase, the number of all words.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bits, pair_bits = known.value
        every: dict[str, _Words] = {}
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                if sum(map(len, every.values())) > KNOWN:
                    every.clear()
                words = every.setdefault(lang, _Words(lang, word_bits))
                carried: list[bytes] = []
                for new in _blocks(own):
                    if len(words) > KNOWN:
                        words.clear()
                    block = carried + new
                    x = np.fromiter(map(words.__getitem__, block), np.int64, len(block))
                    yield from _counted(lang, words, x, len(carried), sizes, pair_bits)
                    carried = block[max(0, len(block) - sizes[1] + 1) :]

    return tidy(rows)


def _counted(lang: str, words: _Words, x: np.ndarray, old: int, sizes: tuple[int, int], pair_bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Phrases of x that end after its first `old` words, which an earlier block has counted."""
    names = words.names
    if sizes[0] == 1:
        counts = np.bincount(x[old:], minlength=1)
        counts[0] = 0
        found = np.flatnonzero(counts)
        yield _batch(lang, [None], counts.sum(keepdims=True))
        yield from _batches(lang, [names[k] for k in found.tolist()], counts[found])
    if sizes[1] == 1 or len(x) < 2:
        return
    frequent = np.array(words.frequent)[x]
    good = frequent[:-1] & frequent[1:]
    if pair_bits is not None:
        hashes = np.array(words.hashes, np.uint64)[x]
        good &= _has(pair_bits, pair_hash(hashes[:-1], hashes[1:]))
    for size, at, counts in _repeats(x, good, old, sizes):
        columns = [[names[i] for i in x[at + k].tolist()] for k in range(size)]
        yield from _batches(lang, list(map(b" ".join, zip(*columns, strict=True))), counts)


def _batches(lang: str, phrases: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(phrases), 100_000):
        yield _batch(lang, phrases[at : at + 100_000], counts[at : at + 100_000])


def _batch(lang: str, phrases: list, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], schema=_ROWS)


def _places(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words or pairs (lang, phrase) to their places in a bitmap: the number of a long, and its bit."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = batch.column("phrase").to_pylist()
            hashes = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), phrases, strict=True):
                parts = [word_hash(lang.encode(), w) for w in phrase.split(b" ")]
                hashes.append(parts if len(parts) == 2 else [parts[0], 0])
            if hashes:
                h = np.array(hashes, np.uint64)
                at = np.where([b" " in p for p in phrases], pair_hash(h[:, 0], h[:, 1]), h[:, 0]) >> np.uint64(64 - bits)
                yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    return rows


def _bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bytes of the bitmap of phrases of one or two words; a row a long that isn't zero reaches the driver, 2**(bits - 6) at most."""
    rows = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(_places(bits), "at long, bits long")
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """(lang, phrase, c) of all phrases of up to `longest` words that occur `least` times or more in their language; and
    without a phrase, the language's number of words."""
    spark = docs.sparkSession
    texts = docs.where("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))

    def counted(sizes: tuple[int, int], *known: np.ndarray | None) -> DataFrame:
        rows = texts.mapInArrow(_phrases(sizes, spark.sparkContext.broadcast(known)), "lang string, phrase binary, c long")
        sums = rows.groupBy("lang", "phrase").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | F.col("phrase").isNull())
        return written(sums.select("lang", F.col("phrase").cast("string").alias("phrase"), "c"), "phrases")

    out = words = counted((1, 1), None, None)
    if longest > 1:
        word_bits = _bitmap(words.where("phrase IS NOT NULL"), bits)
        out = out.unionByName(pairs := counted((2, 2), word_bits, None))
    if longest > 2:
        out = out.unionByName(counted((3, longest), word_bits, _bitmap(pairs, bits)))
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, share: int = SHARE, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a (occurrences), l and r (those of the parts at its worst cut), n (words of the language), score.

    Phrases of 2 to `longest` words with a >= least, without those that lie in a longer one of which
    100 * occurrences >= share * a; the `most` best of each language.
    """
    counts = frequent_phrases(docs, least, longest, bits)
    sizes = counts.where("phrase IS NULL").select("lang", F.col("c").alias("n"))
    counts = counts.where("phrase IS NOT NULL")
    words = F.split("phrase", " ")
    phrases = counts.select("lang", "phrase", F.col("c").alias("a"), words.alias("w")).where(F.size("w") > 1)
    joined = lambda first, many: F.array_join(F.slice("w", first, many), " ")
    cuts = phrases.join(F.broadcast(sizes), "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    for side, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("c").alias(count)), ["lang", side])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(CAST(1000 * CAST(a AS DECIMAL(19,0)) AS DECIMAL(22,0)) * CAST(n AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    shorter = F.explode(F.array(joined(F.lit(1), F.size("w") - 1), joined(F.lit(2), F.size("w") - 1)))
    longer = phrases.where(F.size("w") > 2).select("lang", F.col("a").alias("longer"), shorter.alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * whole("longer") < share * whole("a"), F.lit(True)))
    return _ranked(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), most)


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """rows with `rank` in their language, up to `most`: by ranges of all rows in order, each moved by those before it, so that no task has a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranged = checkpointed(rows.repartitionByRange(F.col("lang"), *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    moved = ranged.groupBy("lang", "part").agg(F.count("*").alias("size")).select("lang", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("moved"))
    inside = ranged.join(moved.where(F.col("moved") < most), ["lang", "part"]).withColumn("own", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    found = inside.withColumn("rank", (F.col("own") + F.col("moved")).cast("long")).where(F.col("rank") <= most)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
