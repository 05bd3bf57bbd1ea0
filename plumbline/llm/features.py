"""Numbers that describe a text's form, for the classifiers; whole texts, a block of words at a time."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_blocks

NAMES = (
    "log_words", "word_bytes", "long_words", "short_words", "distinct_words", "commonest_word", "repeated_word",
    "capitalised_words", "digits", "upper", "symbols", "stops", "exclamations", "bars", "not_ascii", "controls",
    "lines_a_word", "distinct_lines", "commonest_line", "words_ending_in_stops",
)
#: Documents are drawn by hashes under this, fine enough for any number of labels.
DRAWS = 1 << 60
_CLASSES = np.zeros((256, 9))
for _name, _bytes in enumerate((b"0123456789", bytes(range(65, 91)), b"#$%&*+/<=>@\\^_`{}~[]|", b".,;:?", b"!", b"|", bytes(range(128, 256)), bytes([*range(9), *range(14, 32), 127]), bytes([*range(65, 91), *range(97, 123)]))):
    _CLASSES[list(_bytes), _name] = 1


def _block(words: list[bytes]) -> np.ndarray:
    """Of words that are not empty: all features but the first and those of lines."""
    n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
    data = np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256) @ _CLASSES
    total = size.sum()
    shares = data[:8] / total
    shares[1] = data[1] / max(data[8], 1)
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    capital = sum(65 <= w[0] <= 90 for w in words) / n
    stopped = sum(w[-1] in b".,;:!?" for w in words) / n
    own = [total / n, (size > 12).mean(), (size <= 3).mean(), len(counts) / n, max(counts.values()) / n, again, capital]
    return np.array([*own, *shares, stopped])


def features(text: str | None) -> np.ndarray:
    """By NAMES. Shares of a long text are the mean over its blocks; all are 0 for a text without words."""
    data = (text or "").encode("utf-8", "replace")
    out, weight = np.zeros(len(NAMES) - 4), 0
    for words in word_blocks(data):
        if words:
            out += _block(words) * len(words)
            weight += len(words)
    if not weight:
        return np.zeros(len(NAMES))
    out /= weight
    lines = Counter(hash(x) for x in data.split(b"\n") if x)
    n = sum(lines.values())
    return np.array([np.log1p(weight), *out[:-1], n / weight, len(lines) / n, max(lines.values()) / n, out[-1]])


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """docs (doc_id, text) with 0/1 labels, about `most` rows a value of the last column: all, if there are fewer.

    Chosen by a hash of doc_id. Labels that are null or other values, and ids that are null, don't count; a document
    labelled more than once counts once, with its largest labels.
    """
    told = labels.where(F.col("doc_id").isNotNull())
    for c in columns:
        told = told.where(F.col(c).isin(0, 1))
    told = told.groupBy("doc_id").agg(*(F.max(c).cast("int").alias(c) for c in columns))
    known = told.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r[0]: r.n for r in known.groupBy(columns[-1]).agg(F.count("*").alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("labelled")), 4)  # under 2**60
    share = F.lit(0).cast("long")
    for value, n in sizes.items():
        share = F.when(F.col(columns[-1]) == value, F.lit(DRAWS * min(most, n) // n)).otherwise(share)
    chosen = F.broadcast(known.where(draw < share))  # about `most` ids a value
    return docs.join(chosen, "doc_id").select("doc_id", "text", *columns)
