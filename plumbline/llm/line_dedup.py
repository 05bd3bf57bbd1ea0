"""Line dedup by spread over sites: lines that many distinct sources carry are boilerplate.

Each line of at least `chars` characters, trimmed, has a 128-bit key and a HyperLogLog sketch of the sources that
carry it; sketches merge by aggregation, so a line on a third of all rows is counted before it is shuffled. Places of
lines that make up a share HOT of all places or more, at most 1 / HOT of them, are found where they are, and only those of
other lines are shuffled to be met with their keys. Lines whose
estimate is near `sites` get exact distinct counts. A boilerplate line stays where it comes first (by doc_id, then
place) and goes everywhere else, so that no text is lost from the corpus.

Defined results: null text stays null; a null source is no site; shorter lines always stay. Rows that repeat id and
text are one document and are cut alike. A null doc_id sorts first; of documents with one id, the one whose text has the
least hash. Documents stay even if all their lines go. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, compact, fresh, written

SITES, CHARS = 3, 20
#: An estimate within this factor of the threshold is recounted; a sketch errs by 1.6 percent, and hardly at such counts.
BAND = 2.0
SKETCH = 12
HOT = 0.001


def _lines(docs: DataFrame, chars: int) -> DataFrame:
    """(id, print, at, one, two, site): each countable line's place and key."""
    own = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"), F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    trimmed = F.btrim("line", F.lit(" \t\r"))
    return own.select("id", "print", "at", "site", trimmed.alias("line")).where(F.length("line") >= chars).select("id", "print", "at", "site", F.xxhash64("line").alias("one"), F.xxhash64(F.lit("line"), "line").alias("two"))


def boilerplate(lines: DataFrame, sites: int) -> DataFrame:
    """(one, two, first, places): keys of lines on `sites` or more distinct sites, their first place and how many there are."""
    first = F.min(F.struct("id", "print", "at")).alias("first")
    spread = lines.groupBy("one", "two").agg(F.hll_sketch_agg("site", SKETCH).alias("sketch"), first, F.count("*").alias("places"))
    guess = spread.select("one", "two", "first", "places", F.hll_sketch_estimate("sketch").alias("guess")).where(F.col("guess") * BAND >= sites)
    guess = written(compact(guess, lines.count()), "spread")
    sure, near = guess.where(F.col("guess") > sites * BAND), guess.where(F.col("guess") <= sites * BAND)
    # a row a line and site, however many documents of the site carry the line
    carried = lines.select("one", "two", "site").where("site IS NOT NULL").distinct()
    exact = carried.join(near.select("one", "two"), ["one", "two"], "left_semi").groupBy("one", "two").agg(F.count("*").alias("n"))
    told = near.join(exact.where(F.col("n") >= sites).select("one", "two"), ["one", "two"], "left_semi")
    return sure.unionByName(told).select("one", "two", "first", "places")


def line_deduplicated(docs: DataFrame, sites: int = SITES, chars: int = CHARS, removed: str | None = None) -> DataFrame:
    """docs, its columns as they were, without boilerplate lines; `removed` names a column for how many went."""
    lines = written(_lines(docs, chars), "lines")
    found = checkpointed(boilerplate(lines, sites))
    hot = F.col("places") >= HOT * lines.count()
    common = F.broadcast(found.where(hot).drop("places"))  # 1 / HOT rows at most
    met = lines.join(common, ["one", "two"]).unionByName(lines.join(common, ["one", "two"], "left_anti").join(found.where(~hot).drop("places"), ["one", "two"]))
    gone = met.where(~F.struct("id", "print", "at").eqNullSafe(F.col("first")))
    gone = gone.groupBy("id", "print").agg(F.collect_set("at").alias("gone"))
    own_id, own_print, own_gone = (fresh(docs, c) for c in ("line_id", "line_print", "lines_gone"))
    gone = gone.select(F.col("id").alias(own_id), F.col("print").alias(own_print), F.col("gone").alias(own_gone))
    met = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_print)), "left")
    parts = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(own_gone)), lambda k: F.get(parts, k))
    text = F.when(F.col(own_gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if removed:
        out.append(F.greatest(F.coalesce(F.size(own_gone), F.lit(0)), F.lit(0)).cast("long").alias(removed))
    return met.select(*out)
