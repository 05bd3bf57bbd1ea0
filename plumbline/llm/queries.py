"""The queries op1 to op13, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_model, line_rules, quality, toxicity
from .collocations import collocations
from .common import remainder, table
from .decontam import contamination
from .langid import fitted, identified
from .line_dedup import line_deduplicated
from .packing import digests, packed
from .prefix_trie import prefix_trie
from .simhash import simhash_components
from .topk import top_k, vectors
from .url_filter import SUFFIXES, url_filter

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def byte_pairs() -> dict[str, str]:
    """The vocabulary that documents are packed by, in both libraries' formats."""
    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(packed(table(spark, sf_dir, "documents"), **byte_pairs()))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("id") % 100 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id query_id, v.vec_id, sum(q.c * v.c)::BIGINT score
  FROM (SELECT vec_id, unnest(x) c, unnest(range(len(x))) k FROM v WHERE vec_id % 100 = 0) q
  JOIN (SELECT vec_id, unnest(x) c, unnest(range(len(x))) k FROM v) v ON q.k = v.k AND q.vec_id <> v.vec_id
  GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality labels whose doc_id is the page's id."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("outcome"))
    return url_filter(table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  FROM (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') rest FROM pages) x),
told AS (SELECT doc_id page_id, count(*) n, sum(quality) k FROM labels WHERE quality IN (0, 1) GROUP BY 1),
hosts AS (
  SELECT host, coalesce(sum(n), 0) n, coalesce(sum(k), 0) k,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') bare
  FROM cut LEFT JOIN told USING (page_id) GROUP BY 1),
placed AS (
  SELECT host, n, k, bare, regexp_extract(bare, '([^.]*[.])?[^.]*$') last, regexp_matches(bare, '^[0-9.]+$') address FROM hosts),
hosted AS (
  SELECT host, n, k, CASE WHEN address THEN bare WHEN last IN (:suffixes) THEN regexp_extract(bare, '([^.]*[.])?([^.]*[.])?[^.]*$') ELSE last END AS domain,
         CASE WHEN address THEN '[address]' WHEN last IN (:suffixes) THEN last ELSE regexp_extract(bare, '[^.]*$') END suffix FROM placed),
domains AS (SELECT suffix, domain, sum(n) n, sum(k) k FROM hosted GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) n, sum(k) k FROM domains GROUP BY 1),
s0 AS (SELECT *, coalesce((SELECT sum(k) / nullif(sum(n), 0) FROM suffixes), 0.5) m FROM suffixes),
s1 AS (SELECT *, (SELECT 1 / least(greatest(coalesce(sum(CASE WHEN n > 0 THEN n * (k / greatest(n, 1) - m) ** 2 - m * (1 - m) END)
         / nullif(sum(CASE WHEN n > 1 THEN (n - 1) * m * (1 - m) END), 0), 0.001), 0.001), 0.9) - 1 FROM s0) strength FROM s0),
s2 AS (SELECT suffix, (strength * m + k) / (strength + n) mean FROM s1),
d0 AS (SELECT d.*, s2.mean m FROM domains d JOIN s2 USING (suffix)),
d1 AS (SELECT *, (SELECT 1 / least(greatest(coalesce(sum(CASE WHEN n > 0 THEN n * (k / greatest(n, 1) - m) ** 2 - m * (1 - m) END)
         / nullif(sum(CASE WHEN n > 1 THEN (n - 1) * m * (1 - m) END), 0), 0.001), 0.001), 0.9) - 1 FROM d0) strength FROM d0),
d2 AS (SELECT domain, (strength * m + k) / (strength + n) mean FROM d1),
h0 AS (SELECT h.*, d2.mean m FROM hosted h JOIN d2 USING (domain)),
h1 AS (SELECT *, (SELECT 1 / least(greatest(coalesce(sum(CASE WHEN n > 0 THEN n * (k / greatest(n, 1) - m) ** 2 - m * (1 - m) END)
         / nullif(sum(CASE WHEN n > 1 THEN (n - 1) * m * (1 - m) END), 0), 0.001), 0.001), 0.9) - 1 FROM h0) strength FROM h0),
h2 AS (SELECT host, strength * m + k a, strength * (1 - m) + n - k b FROM h1),
bound AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) upper FROM h2),
ruled AS (
  SELECT cut.*, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/es/') THEN 'org/es/' END AS rule
  FROM cut)
SELECT page_id, host, path, rule,
       CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN bound USING (host)
""".replace(":suffixes", ", ".join(f"'{s}'" for s in SUFFIXES))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = quality.fitted(docs.where("NOT held_out").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts without boilerplate lines, with the number of lines that went."""
    docs = line_deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), removed="n_removed")
    return docs.select("doc_id", "text", "n_removed")


OP6_SQL = r"""
WITH cut AS (SELECT doc_id, source, string_split(text, chr(10)) parts FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, source, unnest(parts) line, unnest(range(1, len(parts) + 1)) p FROM cut),
keyed AS (SELECT doc_id, source, line, p, trim(line, ' ' || chr(9) || chr(13)) k FROM lines),
spread AS (SELECT k, min((doc_id, p)) first FROM keyed WHERE length(k) >= 20 GROUP BY 1 HAVING count(DISTINCT source) >= 3),
told AS (SELECT doc_id, p, line, spread.k IS NOT NULL AND (doc_id, p) <> first gone FROM keyed LEFT JOIN spread USING (k)),
joined AS (SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY p), '') AS text, count(*) FILTER (gone) n_removed FROM told GROUP BY 1)
SELECT doc_id, joined.text, coalesce(n_removed, 0) n_removed FROM documents LEFT JOIN joined USING (doc_id)
"""


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    found = identified(docs.select("doc_id", "held_out", "text"), fitted(docs.where("NOT held_out"), pieces_path()), "lang_pred", "score")
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's categories are poor quality, then toxicity; learned from the same rows as op5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    chain = toxicity.fitted(docs.where("NOT held_out").select("doc_id", "text"), labels, ["poor", "toxic"])
    return toxicity.scored(docs, chain).withColumn("toxic", F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0))


def pieces_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') g
        FROM (SELECT item_id, w, size, unnest(range(1, (len(w) - size + 2)::BIGINT)) p FROM bw) x),
occ AS (SELECT doc_id, w, size, unnest(range(1, (len(w) - size + 2)::BIGINT)) p
       FROM d, (SELECT DISTINCT size FROM win) s WHERE len(w) >= size),
found AS (SELECT doc_id, p, occ.size, item_id FROM occ JOIN win ON win.size = occ.size AND win.g = array_to_string(w[p : p + occ.size - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest(range(p, p + size)) q FROM found) x GROUP BY 1),
who AS (SELECT doc_id, count(*) n, string_agg(i, ',' ORDER BY i) names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR i FROM found) x GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(hits.n, 0)::BIGINT n_hit, coalesce(who.n, 0)::BIGINT n_items,
       sha256(coalesce(who.names, '')) items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(d.w) contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN who USING (doc_id)
"""

def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 10) == 0)
    return language_model.scored(docs, language_model.fitted(docs.where("NOT held_out")))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the same rows as op5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_rules.fitted(docs.where(remainder(F.col("doc_id"), 4) != 2), table(spark, sf_dir, "labels"))
    return line_rules.rated(docs, field).select("doc_id", *line_rules.COUNTS, "base_failed", "kept", "content_words")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT n, list_reduce(list_prepend(n, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM unnest(range(256)) t(n)),
crc_all AS (SELECT list(c ORDER BY n) t FROM crc_table),
own AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 p, coalesce(role, '') r, coalesce(text, '') t FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda s, x: xor(crc_all.t[(xor(s, x) & 255) + 1], s >> 8)), 4294967295) % 4 h FROM (SELECT DISTINCT c FROM own) q, crc_all),
glued AS (SELECT convs.c, 0 side, p, r, t FROM convs JOIN own ON own.c = convs.base AND p < h UNION ALL SELECT convs.c, 1, p, r, t FROM convs JOIN own ON own.c = convs.c AND p >= h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, p) d, r, t FROM glued),
pre AS (SELECT c, d, t, list(sha256(length(r) || ':' || r || t)) OVER (PARTITION BY c ORDER BY d) k FROM turns UNION ALL SELECT c, 0, '', [] FROM convs),
keyed AS (SELECT c, d, sha256(array_to_string(k, ',')) k, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) w FROM pre),
nodes AS (SELECT k, any_value(d) d, min(c) o, count(*) n, any_value(w) w FROM keyed GROUP BY 1),
up AS (SELECT x.k, y.k pk, nodes.o po FROM (SELECT k, d, o FROM nodes WHERE d > 0) x JOIN keyed y ON y.c = x.o AND y.d = x.d - 1 JOIN nodes ON nodes.k = y.k),
kids AS (SELECT pk k, count(*) kids FROM up GROUP BY 1),
under AS (SELECT y.k, sum((nodes.n - 1) * nodes.w) saved, count(*) FILTER (kids.kids IS NULL) leaves FROM nodes LEFT JOIN kids USING (k) JOIN keyed y ON y.c = nodes.o AND y.d <= nodes.d GROUP BY 1),
fin AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) ids FROM keyed JOIN (SELECT c, max(d) d FROM keyed GROUP BY 1) z USING (c, d) GROUP BY 1)
SELECT nodes.o conv_id, d::BIGINT AS depth, po parent_conv_id, n n_convs, coalesce(kids.kids, 0) n_children, leaves n_leaves, saved::BIGINT saved_tokens, sha256(coalesce(ids, '')) ends_sha256
FROM nodes LEFT JOIN up USING (k) LEFT JOIN kids USING (k) JOIN under USING (k) LEFT JOIN fin USING (k)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::HUGEINT n FROM w GROUP BY 1),
grams AS (SELECT lang, k, w[p : p + k - 1] g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) p FROM w, unnest(range(1, 6)) s(k) WHERE len(w) >= k) x),
f AS (SELECT lang, k, g, count(*)::HUGEINT a FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 100),
cuts AS (SELECT f.*, n, cut, l.a l, r.a r, 1000 * f.a * n // (l.a * r.a) score
         FROM (SELECT *, unnest(range(1, k)) cut FROM f WHERE k > 1) f JOIN sizes USING (lang)
         JOIN f l ON l.lang = f.lang AND l.g = f.g[1 : cut] JOIN f r ON r.lang = f.lang AND r.g = f.g[cut + 1 : f.k]),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_parts AS (SELECT lang, g[s : s + j - 1] g, a FROM (SELECT f.*, j, unnest(range(1, k - j + 2)) s FROM f, unnest(range(2, 5)) y(j) WHERE k > j) x),
inside AS (SELECT lang, g, max(a) longer FROM inner_parts GROUP BY 1, 2),
best AS (SELECT lang, array_to_string(g, ' ') phrase, a, l, r, n, score FROM worst LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT a, l::BIGINT l, r::BIGINT r, n::BIGINT n, score::BIGINT score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_topk": op3_topk,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_langid": op7_langid,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_model": op10_language_model,
    "op11_line_rules": op11_line_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}
SQL = {"op3_topk": OP3_SQL, "op4_url_filter": OP4_SQL, "op6_line_dedup": OP6_SQL, "op9_decontaminate": OP9_SQL, "op12_prefix_trie": OP12_SQL, "op13_collocations": OP13_SQL}
