import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import prefix_trie as pt

ROWS = "conv_id long, turn long, role string, text string, depth long, owner string"


def plain(rows, group, heads):
    """The tree in dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h, rest = zlib.crc32(str(c).encode()) % heads, abs(c) % group
        made[c] = own.get(c - (rest if c >= 0 else -rest), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        kids = lambda k: sum(len(q) == len(k) + 1 and q[: len(k)] == k for q in nodes)
        words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), kids(key), sum(not kids(k) for k in under), sum((len(nodes[k]) - 1) * words(k) for k in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(n, seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -20, -25, 1000, 1020, 1040, 2007]:
        for t in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t if t or r.random() < 0.7 else None, r.choice(["user", "bot", None, ""]), r.choice(["hi", "hi there", "", None, "a\tb\n c", "é x", "long " * 30])))
    return rows + [(None, 0, "user", "no conversation")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], ROWS)


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("group", "heads", "hot"), [(20, 4, 0.001), (5, 3, 0.2), (20, 4, 0.02)])
def test_matches_brute_force(spark, monkeypatch, group, heads, hot):
    monkeypatch.setattr(pt, "HOT", hot)
    monkeypatch.setattr(pt, "BLOCK", 3)
    rows = talks(60)
    assert told(pt.prefix_trie(frame(spark, rows).repartition(5), group, heads)) == plain(rows, group, heads)


def test_nested_chains_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 16)
    monkeypatch.setattr(pt, "STRETCH", 8)
    rows = [(c, t, "user", f"{min(t, 3)}") for c in range(1, 40) for t in range(5)]  # one group of copies
    rows += [(100 + c, t, "bot", "x" if t <= c else f"{c} {t}") for c in range(12) for t in range(14)]  # each chain hangs from the one before
    rows += [(500, t, "user", f"t{t}") for t in range(300)]
    assert told(pt.prefix_trie(frame(spark, rows).repartition(7), 1, 1)) == plain(rows, 1, 1)


def test_equal_turn_numbers_and_repeated_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    got = told(pt.prefix_trie(frame(spark, rows), 1, 1))
    assert [r[:4] for r in got] == [(1, 0, None, 2), (1, 1, 1, 2), (1, 2, 1, 2), (1, 3, 1, 2)]  # whatever their order, both have the same
    assert got[-1][-1] == hashlib.sha256(b"1,2").hexdigest()


def test_stretches_of_ids_make_the_same_digests(spark, monkeypatch):
    monkeypatch.setattr(pt, "STRETCH", 20)
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, 3]), 0, c) for c in r.sample(range(-500, 5000), 900)]
    ends = spark.createDataFrame(rows, "a long, b long, conv long").repartition(6)
    got = {r.a: r.digest for r in pt.end_digests(ends).collect()}
    assert got == {a: hashlib.sha256(",".join(map(str, sorted(c for x, _, c in rows if x == a))).encode()).hexdigest() for a in (1, 2, 3)}


def test_empty(spark):
    assert pt.prefix_trie(frame(spark, []).where("false")).collect() == []
    assert pt.prefix_trie(frame(spark, [(None, 1, "user", "x")])).collect() == []


def test_places_by_ranges(spark):
    rows = frame(spark, [(1, t, "user", str(t)) for t in range(2000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = pt.placed(rows)
        assert own.select("part").distinct().count() > 4  # one conversation in many tasks
        known = pt.prefixes(pt.rebuilt(rows, 20, 1))
        assert known.count() == 2001 == known.select("a", "b").distinct().count() == known.agg(F.max("depth") + 1).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
