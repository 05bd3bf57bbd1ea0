"""Language ID by unigram pieces whose segmentations are summed out.

The pieces are those of a fixed public vocabulary. For each language, expectation-maximisation learns a probability of
each piece from the words of labelled documents; a word's probability is the sum over all its segmentations, by a
forward algorithm over many words at once, or, for a word longer than LONGEST, along the word with as many places in
memory as a piece is long. A text's evidence is the sum over all its words; beyond EVIDENCE words it
is scaled to that many, so that the posterior tells a mixture of languages from one language.

The fit uses a hashed sample of about `sample` labelled documents a language, all of them where there are fewer.
Every word of every text is scored.

Defined results: null text or no letter: `und` with score 0, as for all texts if no language could be learned. Words
are lower-cased runs of letters, of any length; characters that the vocabulary lacks share one piece. A run longer than
LONGEST is scored whole but teaches by its parts of that length. Ties go to the language that sorts first. Repeated rows are scored each; null labels teach nothing.
An empty table stays empty.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, tidy

RUNS = re.compile(r"[^\W\d_]+")
MARK, LONGEST = "▁", 40
SAMPLE, ROUNDS, EVIDENCE = 800, 4, 20
#: Words that a worker remembers, and words that go through the forward algorithm at once.
REMEMBERED, AT_ONCE = 100_000, 8192
UND = "und"


def runs(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return list(itertools.chain.from_iterable("".join(c if c.isalpha() else " " for c in w).split() for w in found))


def parts_of(words: list[str]) -> list[str]:
    """words, those longer than LONGEST cut."""
    return [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters, with or without the mark of a word's begin, from a sentencepiece file; 0 and 1 are kept for none and other."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    lower = {model.id_to_piece(k).lower() for k in range(model.vocab_size())}
    return {p: k for k, p in enumerate(sorted(p for p in lower if p == MARK or p.removeprefix(MARK).isalpha()), 2)}


class Index:
    """Pieces by a 64-bit hash of their characters, so that all spans of many words are looked up at once."""

    BASE, SLOTS = 0x9E3779B97F4A7C15, 20

    def __init__(self, pieces: dict[str, int]):
        mask, hashes = (1 << 64) - 1, {}
        self.longest = max(map(len, pieces), default=1)
        for piece, k in pieces.items():
            h = 0
            for c in piece:
                h = (h * self.BASE + ord(c) + 1) & mask
            hashes[k] = h
        self.keys = np.zeros(max(hashes, default=1) + 1, np.uint64)
        self.keys[list(hashes)] = list(hashes.values())
        for seed in range(1, 100):  # the few pieces whose slot is taken go to a second table
            self.factors = [(seed * x | 1) & mask for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
            self.tables = [np.zeros(1 << self.SLOTS, np.int32) for _ in range(2)]
            if all(self._placed(k, h, mask) for k, h in hashes.items()):
                return
        raise ValueError("the pieces don't fit two tables")

    def _placed(self, k: int, h: int, mask: int) -> bool:
        for table, factor in zip(self.tables, self.factors, strict=True):
            at = (h * factor & mask) >> (64 - self.SLOTS)
            if not table[at]:
                table[at] = k
                return True
        return False

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Their pieces' ids, 0 for none."""
        first, second = (np.uint64(f) for f in self.factors)
        out = self.tables[0][hashes * first >> np.uint64(64 - self.SLOTS)]
        other = np.flatnonzero((out > 0) & (self.keys[out] != hashes))
        if len(other):
            rest = hashes.ravel()[other] if hashes.ndim > 1 else hashes[other]
            found = self.tables[1][rest * second >> np.uint64(64 - self.SLOTS)]
            out.ravel()[other] = np.where(self.keys[found] == rest, found, 0)
        return out


class Lattices:
    """The piece ids of all spans of marked words of one length: (span, word)."""

    def __init__(self, words: list[str], index: Index):
        n = len(words[0]) + 1
        self.n, self.spans = n, [(i, j) for j in range(1, n + 1) for i in range(max(0, j - index.longest), j)]
        codes = np.array([MARK + w for w in words], f"<U{n}").view(np.uint32).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        base = np.uint64(Index.BASE)
        powers, upto = [np.uint64(1)], [np.zeros(len(words), np.uint64)]
        with np.errstate(over="ignore"):
            for k in range(n):
                powers.append(powers[-1] * base)
                upto.append(upto[-1] * base + codes[k])
            hashes = np.stack([upto[j] - upto[i] * powers[j - i] for i, j in self.spans])
            self.ids = index(hashes)
        for k, (i, j) in enumerate(self.spans):
            if j == i + 1:
                self.ids[k][self.ids[k] == 0] = 1

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p: (pieces, languages). The spans' probabilities and alpha at (place, word, language)."""
        span = p[self.ids]
        alpha = np.zeros((self.n + 1, self.ids.shape[1], p.shape[1]))
        alpha[0] = 1
        for k, (i, j) in enumerate(self.spans):
            alpha[j] += alpha[i] * span[k]
        return span, alpha

    def expected(self, p: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """Adds each piece's expected count, given the words' counts (words, languages), to out."""
        span, alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[self.n] = counts / np.maximum(alpha[self.n], 1e-300)
        for k in range(len(self.spans) - 1, -1, -1):
            i, j = self.spans[k]
            beta[i] += span[k] * beta[j]
        for k, (i, j) in enumerate(self.spans):
            weight = alpha[i] * span[k] * beta[j]
            for lang in range(p.shape[1]):
                out[:, lang] += np.bincount(self.ids[k], weight[:, lang], len(out))


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Indices of words of one length up to LONGEST, AT_ONCE or fewer; fewer for long words, whose lattices are larger."""
    groups = defaultdict(list)
    for k, w in enumerate(words):
        if len(w) <= LONGEST:
            groups[len(w)].append(k)
    for n, g in groups.items():
        most = max(1, AT_ONCE * 8 // (8 + n))
        for k in range(0, len(g), most):
            yield g[k : k + most]


def log_probability(word: str, index: Index, p: np.ndarray) -> np.ndarray:
    """(languages), all segmentations of one word of any length summed; some thousand letters are looked up at a time."""
    marked, reach, base = MARK + word, index.longest, np.uint64(Index.BASE)
    alpha, scale = np.zeros((reach, p.shape[1])), np.zeros(p.shape[1])  # of the last places, the latest first
    alpha[0] = 1
    for at in range(0, len(marked), AT_ONCE):
        begin = max(0, at + 1 - reach)
        codes = np.frombuffer(marked[begin : at + AT_ONCE].encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        ends = np.arange(at + 1 - begin, len(codes) + 1)
        ids, hashes = np.zeros((len(ends), reach), np.int32), np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, min(reach, len(codes)) + 1):
                hashes = hashes[: len(codes) - size + 1] * base + codes[size - 1 :]
                inside = ends >= size
                ids[inside, size - 1] = index(hashes)[ends[inside] - size]
        ids[:, 0][ids[:, 0] == 0] = 1
        for span in p[ids]:
            new = (span * alpha).sum(axis=0)
            alpha[1:] = alpha[:-1]
            alpha[0] = new
            if new.min() < 1e-100:
                most = alpha.max(axis=0)
                alpha /= most
                scale += np.log(most)
    return scale + np.log(alpha[0])


def log_probabilities(words: list[str], index: Index, p: np.ndarray) -> np.ndarray:
    """(words, languages), all segmentations summed."""
    out = np.empty((len(words), p.shape[1]))
    for k, w in enumerate(words):
        if len(w) > LONGEST:
            out[k] = log_probability(w, index, p)
    for g in by_length(words):
        lattice = Lattices([words[k] for k in g], index)
        out[g] = np.log(np.maximum(lattice.forward(p)[1][lattice.n], 1e-300))
    return out


def learned(counts: dict[str, Counter], pieces: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces, languages), from word counts by language."""
    langs = sorted(counts)
    words = sorted(set().union(*counts.values()))
    table = np.array([[counts[x][w] for x in langs] for w in words], float).reshape(len(words), len(langs))
    p = np.full((len(pieces) + 2, len(langs)), 1 / (len(pieces) + 1))
    p[0] = 0
    index = Index(pieces)
    for _ in range(rounds):
        got = np.zeros_like(p)
        for g in by_length(words):
            Lattices([words[k] for k in g], index).expected(p, table[g], got)
        got[0] = 0
        got[1:] += 0.01  # a piece not met stays possible
        p = got / got.sum(axis=0)
    return langs, p


def sampled_counts(docs: DataFrame, sample: int) -> dict[str, Counter]:
    """Word counts by language over about `sample` documents of each."""
    told = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in told.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*itertools.chain.from_iterable((F.lit(x), F.lit(min(1.0, sample / n))) for x, n in sizes.items()))
    chosen = told.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found[lang].update(parts_of(runs(text.as_py())))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    out: dict[str, Counter] = {}
    for r in chosen.mapInArrow(tidy(batches), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        out.setdefault(r.lang, Counter())[r.word] = r.n
    return out


class Identifier:
    def __init__(self, langs: list[str], p: np.ndarray, pieces: dict[str, int]):
        self.langs, self.p, self.pieces, self.index = langs, p, pieces, Index(pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.known) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        split, known = [runs(t) for t in texts], self.known
        new = [w for w in dict.fromkeys(itertools.chain.from_iterable(split)) if w not in known and len(w) <= LONGEST]
        if new and self.langs:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, log_probabilities(new, self.index, self.p)))
        return [self._one(words) for words in split]

    def _one(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.langs:
            return UND, 0.0
        if long := [w for w in words if w not in self.known]:
            words = [w for w in words if w in self.known]
        total = self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
        total += log_probabilities(long, self.index, self.p).sum(axis=0)
        total *= min(1, EVIDENCE / (len(words) + len(long)))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


#: Characters of text that are split at a time; one text more may come on top.
CHARS = 1 << 22


def identified(docs: DataFrame, identifier: Identifier, lang: str, score: str) -> DataFrame:
    """docs with the language and score of text."""
    sent = docs.sparkSession.sparkContext.broadcast((identifier.langs, identifier.p, identifier.pieces))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Identifier(*sent.value)
        for batch in it:
            found, held, size = [], [], 0
            for text in batch.column("text"):
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size > CHARS:
                    found += use(held)
                    held, size = [], 0
            found += use(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, lang, score])

    return docs.mapInArrow(tidy(batches), T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def fitted(docs: DataFrame, path: str, sample: int = SAMPLE) -> Identifier:
    """An identifier learned from text and lang of docs."""
    pieces = vocabulary(path)
    return Identifier(*learned(sampled_counts(docs, sample), pieces), pieces)


def in_known_language(docs: DataFrame, identifier: Identifier, least: float = 0.5) -> DataFrame:
    """docs, its columns as they were, without those of no language or of a score under `least`."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = identified(docs, identifier, lang, score)
    return found.where((F.col(lang) != UND) & (F.col(score) >= least)).select(*docs.columns)
