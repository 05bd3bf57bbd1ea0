"""Quality rules: plain counts over a text, and a linear-chain conditional random field that marks its lines.

Each line with a word is described by its form (FEATURES) and labelled content or boilerplate by the labels' most likely
sequence (Viterbi decoding) under weights for the features and for a label following a label. A document is kept if no plain
rule fails it and content lines hold SHARE of its words or more. There are no labels of lines to learn from, so the field
is taught by documents': all lines of a poor document are boilerplate, those of a good one content. It is fitted to at
most SAMPLE documents of each label, chosen by a hash, and SPAN lines in sequence of each, from a hashed place.

Defined results: null and empty texts have no words and fail the plain rules. A null label, or one that isn't 0 or 1, doesn't
count; without documents of both labels all lines are content, so that only the plain rules decide. Repeated rows
are judged each; an empty table stays empty. A text of any length is read whole; memory grows with one text's words, and
texts are joined in blocks of BLOCK bytes. Columns of docs whose names are those of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .features import labelled_sample

SHARE, SAMPLE, SPAN = 0.5, 2000, 40
LEAST_WORDS, MOST_REPEATED = 50, 50
BLOCK = 1 << 21
#: Strength of the normal prior on weights, steps of the fit.
PRIOR, STEPS = 1.0, 60
#: Kinds of bytes.
SPACE, LOWER, UPPER, DIGIT, SYMBOL, BAR, STOP, SHOUT, CONTROL, HIGH, CONTINUED, OTHER = range(12)
_KIND = np.full(256, OTHER, np.uint8)
for _kind, _bytes in ((CONTROL, [*range(32), 127]), (SPACE, [32, *range(9, 14)]), (LOWER, range(97, 123)), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (SYMBOL, b"#*$%&<>"), (BAR, b"|"), (STOP, b".,;:?"), (SHOUT, b"!"), (CONTINUED, range(128, 192)), (HIGH, range(192, 256))):
    _KIND[list(_bytes)] = _kind
_KINDS = 12
FEATURES = (
    "log_words", "word_characters", "upper", "digits", "symbols_a_word", "bars_a_word", "stops_a_word", "shouts_a_word", "controls",
    "other", "high", "ends_in_a_stop", "begins_upper", "seen_before", "short",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Lines:
    """Of a block of texts: counts by text (texts, COUNTS), and of lines with a word their text, number, words and features."""

    counts: np.ndarray
    text: np.ndarray
    number: np.ndarray
    words: np.ndarray
    features: np.ndarray


def described(texts: list[bytes]) -> Lines:
    data = b"\n".join(texts)
    raw = np.frombuffer(data, np.uint8)
    kinds = _KIND[raw]
    breaks = np.flatnonzero(raw == 10)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(raw)]))
    n_lines = len(starts)
    line_of = np.repeat(np.arange(n_lines, dtype=np.int32), ends - starts + 1)[: len(raw)]  # a line's break is its own
    kind = np.bincount(line_of * np.int64(_KINDS) + kinds, minlength=n_lines * _KINDS).reshape(n_lines, _KINDS)
    per_text = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(n_lines) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    spaces = kinds == SPACE
    begins = np.flatnonzero(~spaces & np.concatenate(([True], spaces[:-1]))) if len(raw) else np.zeros(0, np.int64)
    words = np.bincount(line_of[begins], minlength=n_lines)
    seen, told = set(), np.zeros(n_lines, bool)
    full = np.flatnonzero(words)
    for k, own in zip(full.tolist(), text_of[full].tolist(), strict=True):
        key = (own, data[starts[k] : ends[k]])
        told[k] = key in seen
        seen.add(key)
    characters = kind[:, LOWER:].sum(axis=1) - kind[:, CONTINUED]
    by_text = lambda x: np.bincount(text_of, x, len(texts)).astype(np.int64)
    counts = np.stack([by_text(words), by_text(characters), by_text(kind[:, SYMBOL] + kind[:, BAR]), by_text(told), _repeated(data.split(), text_of[line_of[begins]], len(texts))], axis=1)
    kind, n, size = kind[full].astype(float), words[full].astype(float), characters[full].astype(float)
    letters = np.maximum(kind[:, LOWER] + kind[:, UPPER], 1)
    last, first = _edges(raw, spaces, starts[full], ends[full])
    columns = [
        np.log1p(n), size / n, kind[:, UPPER] / letters, kind[:, DIGIT] / size, kind[:, SYMBOL] / n, kind[:, BAR] / n, kind[:, STOP] / n, kind[:, SHOUT] / n, kind[:, CONTROL] / size,
        kind[:, OTHER] / size, kind[:, HIGH] / size, np.isin(last, list(b".?!")), (first >= 65) & (first <= 90) | (first >= 192), told[full], n <= 3,
    ]
    return Lines(counts, text_of[full], number[full], words[full], np.stack(columns, axis=1).astype(float) if len(full) else np.zeros((0, len(FEATURES))))


def _edges(raw: np.ndarray, spaces: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last and the first byte of lines' words; each line has one."""
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    marks = np.flatnonzero(~spaces)
    return raw[marks[np.searchsorted(marks, ends) - 1]], raw[marks[np.searchsorted(marks, starts)]]


def _repeated(words: list[bytes], text: np.ndarray, n_texts: int) -> np.ndarray:
    """By text: its words that lie in a run of three words which the text has twice or more."""
    known: dict[bytes, int] = {}
    x = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    own = np.flatnonzero(text[2:] == text[:-2]) if len(x) > 2 else np.zeros(0, np.int64)
    if not len(own):
        return np.zeros(n_texts, np.int64)
    number = x[own]
    for more in (x[own + 1], x[own + 2], text[own]):
        number = np.unique(number * (int(more.max()) + 1) + more, return_inverse=True)[1]
    again = own[np.bincount(number)[number] > 1]
    inside = np.zeros(len(x), bool)
    for k in range(3):
        inside[again + k] = True
    return np.bincount(text[inside], minlength=n_texts)


@dataclass
class Field:
    """Weights of boilerplate over content: of the standardised features and a constant, of a label after a label, and of the first."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    after: np.ndarray
    first: float

    def evidence(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale
        return np.clip(z, -8, 8) @ self.weights[:-1] + self.weights[-1]


def likelihood(z: np.ndarray, labels: np.ndarray, real: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of label sequences and its gradient, by the forward and backward recursions.

    z: (sequences, lines, features with a constant), real: which of the lines there are, from the first on without a gap.
    theta: weights of features, the four of a label after a label (content first), and that of a first boilerplate.
    """
    n, size, width = z.shape
    after, first = theta[width : width + 4].reshape(2, 2), theta[-1]
    score = np.zeros((n, size, 2))
    score[..., 1] = z @ theta[:width]
    score[:, 0, 1] += first
    forward = score.copy()
    for t in range(1, size):
        step = np.logaddexp(forward[:, t - 1, 0, None] + after[0], forward[:, t - 1, 1, None] + after[1])
        forward[:, t] = np.where(real[:, t, None], score[:, t] + step, forward[:, t - 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    backward = np.zeros((n, size, 2))
    pairs = np.zeros((2, 2))
    for t in range(size - 2, -1, -1):
        ahead = score[:, t + 1] + backward[:, t + 1]
        step = np.logaddexp(after[None, :, 0] + ahead[:, 0, None], after[None, :, 1] + ahead[:, 1, None])
        backward[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        there = real[:, t + 1]
        both = forward[there, t, :, None] + after[None] + ahead[there, None, :] - total[there, None, None]
        pairs += np.exp(both).sum(axis=0)
    expected = np.exp(forward + backward - total[:, None, None])[..., 1] * real
    # told: score of the labels, and what the gradient sees of them
    seen = np.zeros((2, 2))
    follow = real[:, 1:]
    np.add.at(seen, (labels[:, :-1][follow], labels[:, 1:][follow]), 1)
    own = (score[..., 1] * labels * real).sum() + (seen * after).sum()
    residual = labels * real - expected
    gradient = np.concatenate([np.einsum("nt,ntf->f", residual, z), (seen - pairs).ravel(), [residual[:, 0].sum()]])
    return float(own - total.sum()), gradient


def climbed(f, theta: np.ndarray) -> np.ndarray:  # noqa: ANN001
    """Where f (value, gradient) is greatest, by limited-memory quasi-Newton steps."""
    value, gradient = f(theta)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step, alphas = gradient.copy(), []
        for s, y in reversed(kept):
            alphas.append((s @ step) / (s @ y))
            step -= alphas[-1] * y
        if kept:
            s, y = kept[-1]
            step *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(kept, reversed(alphas), strict=True):
            step += s * (alpha - (y @ step) / (s @ y))
        rate = 1.0 if kept else 1.0 / max(np.abs(gradient).sum(), 1e-12)
        while rate > 1e-10:
            new, slope = f(theta + rate * step)
            if new >= value + 1e-4 * rate * (step @ gradient):
                break
            rate /= 2
        else:
            return theta
        s, y = rate * step, gradient - slope
        if s @ y > 1e-12:
            kept = [*kept[-9:], (s, y)]
        done = new - value < 1e-7 * abs(value)
        theta, value, gradient = theta + s, new, slope
        if done:
            break
    return theta


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, label) to (label, features): SPAN lines of each text, from a hashed place."""
    for batch in batches:
        labels, spans = [], []
        for doc, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True):
            found = described([(text or "").encode("utf-8", "replace")]).features
            if len(found):
                at = xxhash.xxh64_intdigest(str(doc)) % max(1, len(found) - SPAN + 1)
                labels.append(label)
                spans.append(found[at : at + SPAN].astype(np.float32).tobytes())
        yield pa.record_batch([pa.array(labels, pa.int32()), pa.array(spans, pa.binary())], names=["label", "features"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """docs (doc_id, text), labels (doc_id, quality: 1 good, 0 poor). None without documents of both kinds.

    The driver holds at most SPAN lines of about `sample` documents of each label.
    """
    rows = labelled_sample(docs, labels, ["quality"], sample).select("doc_id", "text", (1 - F.col("quality")).alias("label"))
    rows = sorted(tuple(r) for r in rows.mapInArrow(tidy(_spans), "label int, features binary").collect())
    if len({label for label, _ in rows}) < 2:
        return None
    spans = [np.frombuffer(f, np.float32).reshape(-1, len(FEATURES)).astype(float) for _, f in rows]
    every = np.concatenate(spans)
    mean, scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-6)
    z = np.zeros((len(spans), SPAN, len(FEATURES) + 1))
    real = np.zeros((len(spans), SPAN), bool)
    for k, own in enumerate(spans):
        z[k, : len(own), :-1], z[k, : len(own), -1], real[k, : len(own)] = np.clip((own - mean) / scale, -8, 8), 1, True
    told = np.repeat(np.array([label for label, _ in rows])[:, None], SPAN, axis=1)

    def posterior(theta: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = likelihood(z, told, real, theta)
        return value - PRIOR * theta @ theta / 2, gradient - PRIOR * theta

    theta = climbed(posterior, np.zeros(z.shape[2] + 5))
    return Field(mean, scale, theta[: z.shape[2]], theta[z.shape[2] : -1].reshape(2, 2), float(theta[-1]))


def decoded(field: Field | None, features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each line is boilerplate: the likeliest labels of each text's lines, content where two are equally likely."""
    out = np.zeros(len(text), bool)
    if field is None or not len(text):
        return out
    evidence, owner = field.evidence(features).tolist(), text.tolist()
    (cc, cb), (bc, bb) = field.after.tolist()
    came = bytearray(len(owner))  # bit 0: content after boilerplate is better, bit 1: boilerplate after boilerplate is
    content = boilerplate = 0.0
    ends: list[tuple[int, bool]] = []
    for k, (own, e) in enumerate(zip(owner, evidence, strict=True)):
        if k and own == owner[k - 1]:
            a, b, c, d = content + cc, boilerplate + bc, content + cb, boilerplate + bb
            came[k] = (b > a) | ((d > c) << 1)
            content, boilerplate = max(a, b), max(c, d) + e
            top = max(content, boilerplate)
            content, boilerplate = content - top, boilerplate - top
        else:
            if k:
                ends.append((k - 1, boilerplate > content))
            content, boilerplate = 0.0, e + field.first
    ends.append((len(owner) - 1, boilerplate > content))
    begins = [0, *(k + 1 for k, _ in ends[:-1])]
    for begin, (k, label) in zip(begins, ends, strict=True):
        for at in range(k, begin - 1, -1):
            out[at] = label
            label = bool(came[at] >> label & 1)
    return out


def _rated(field: Field | None, share: float, keep: list[str]):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("line_rules_text").to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                block: list[bytes] = []
                while end < len(texts) and (not block or size + len(texts[end] or b"") <= BLOCK):
                    block.append(texts[end] or b"")
                    size += len(block[-1])
                    end += 1
                yield _block_rows(batch.slice(begin, end - begin), block, field, share, keep)
                begin = end

    return tidy(rows)


def _block_rows(batch: pa.RecordBatch, texts: list[bytes], field: Field | None, share: float, keep: list[str]) -> pa.RecordBatch:
    found = described(texts)
    marked = decoded(field, found.features, found.text)
    n, repeated = found.counts[:, 0], found.counts[:, 4]
    content = np.bincount(found.text[~marked], found.words[~marked], len(texts)).astype(np.int64)
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(found.text[marked], minlength=len(texts))))).astype(np.int32)
    lines = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.number[marked], pa.int64()))
    out = [*(batch.column(c) for c in keep), *(pa.array(found.counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(~failed & (content >= share * n)), pa.array(content), lines]
    return pa.record_batch(out, names=[*keep, *COUNTS, "base_failed", "kept", "content_words", "boilerplate_lines"])


def rated(docs: DataFrame, field: Field | None, share: float = SHARE) -> DataFrame:
    """docs with COUNTS, base_failed, kept, content_words, and boilerplate_lines, the numbers (from 0) of lines so marked."""
    results = {*COUNTS, "base_failed", "kept", "content_words", "boilerplate_lines"}
    keep = [c for c in docs.columns if c.lower() not in results]
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    schema = docs.select(*keep).schema
    for f in docs.sparkSession.createDataFrame([], f"{kinds}, base_failed boolean, kept boolean, content_words long, boilerplate_lines array<long>").schema:
        schema = schema.add(f)
    return docs.select(*keep, F.col("text").cast("binary").alias("line_rules_text")).mapInArrow(_rated(field, share, keep), schema)
