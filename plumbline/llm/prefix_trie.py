"""Prefix tree of conversations: which conversations start alike, how far, and what a shared prefix would save.

A conversation's prefix of depth d is known by the sums, in four words of 32 bits, of a hash of each of its turns with the
turn's depth. Sums can be made in stretches: ranges of all turns in order give each turn its place, and running sums are
made by blocks of BLOCK turns and then moved by those of the blocks before, so a conversation of any length is dealt out.
A node of the tree is a prefix that some conversation has; the smallest such conversation owns it. What a conversation owns
is the end of it, as the owner of a prefix owns all longer ones of its own, so the first depth that it owns is found by
binary search: in each round all open conversations ask for the owner of one prefix, by a join with the owners of all.
Owned stretches are the tree's chains. Chains hang from nodes of others, and their totals are added up from those without
any to the root; in a round, all chains that nothing open hangs from.

Prefixes of a share HOT of all prefixes or more, 1 / HOT at most, are met where the conversations are. The ids of the
conversations that end at a node are hashed in order from ranges of (node, id), and only nodes on more than one range are
put together from their stretches, which are streamed.

Defined results: turns go by number, null first, those with one number by a hash of role and text; a row that is repeated
is a turn of its own. Null role or text is empty. Rows without conv_id belong to no conversation. An empty table has no
nodes. Texts of any length count whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, tidy, written

#: Turns of a conversation that are summed in one task, ranges of turns to a task, and the share of prefixes that is common.
BLOCK, HOT = 4096, 0.001
#: Bytes of ids that are put together before they are passed on.
STRETCH = 1 << 18
LIMBS = ("s0", "s1", "s2", "s3")


def placed(rows: DataFrame) -> DataFrame:
    """(conv, part, pos, one, two, words): each turn's place in its conversation from 0, by ranges of all turns."""
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    own = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(*content).alias("one"), F.xxhash64(F.lit("turn"), *content).alias("two"),
        F.regexp_count(content[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = [F.asc_nulls_first("turn"), F.col("one"), F.col("two")]
    own = own.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id())
    own = own.withColumn("own_pos", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1)
    return written(own.select("conv", "part", "own_pos", "one", "two", "words"), "turns")


def rebuilt(rows: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv, depth from 1, one, two, words): the first h turns of conversation c - c % group, h = crc32(c) % heads, and c's own after its first h; and (conv, depth 0) for each."""
    own = placed(rows)
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = own.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("moved", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = (F.col("conv") - F.col("conv") % group).alias("base")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    sizes = stretches.groupBy("conv").agg(F.sum("n").alias("n"))
    convs = sizes.select("conv", base, h).join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = checkpointed(convs.select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")))
    # every stretch of a conversation has its own row of what it is to be moved by, so a long one is met by stretches
    moves = stretches.join(convs, "conv").select("conv", "part", "h", (F.col("moved") - F.col("h") + F.col("m") + 1).alias("shift"), "moved")
    tails = own.join(moves, ["conv", "part"]).where(F.col("own_pos") + F.col("moved") >= F.col("h"))
    tails = tails.select("conv", (F.col("own_pos") + F.col("shift")).alias("depth"), "one", "two", "words")
    firsts = own.where(F.col("own_pos") < heads).join(stretches.select("conv", "part", "moved"), ["conv", "part"])
    firsts = firsts.select(F.col("conv").alias("base"), (F.col("own_pos") + F.col("moved")).alias("pos"), "one", "two", "words")
    starts = convs.join(firsts, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "one", "two", "words")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("one", "two", "words")))
    return roots.unionByName(starts).unionByName(tails)


def _summed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with sums, by the columns' names, over the rows of the conversation up to this depth."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({name: F.sum(c).over(upto) for name, c in columns.items()})
    blocks = rows.groupBy("conv", "block").agg(*(F.sum(c).alias(f"{name}_all") for name, c in columns.items()))
    moves = blocks.select("conv", "block", *(F.sum(f"{name}_all").over(before).alias(f"{name}_moved") for name in columns)).where("block > 0")
    out = inside.join(moves, ["conv", "block"], "left")
    return out.withColumns({name: F.col(name) + F.coalesce(f"{name}_moved", F.lit(0)) for name in columns}).drop("block", *(f"{name}_moved" for name in columns))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, words): each conversation's prefixes by 128 bits."""
    both = [F.xxhash64("depth", "one", "two"), F.xxhash64("two", "one", "depth")]
    halves = [h for x in both for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = _summed(turns, dict(zip(LIMBS, halves, strict=True)))
    return sums.select("conv", "depth", F.xxhash64("depth", *LIMBS).alias("a"), F.xxhash64(*LIMBS[::-1], "depth").alias("b"), "words")


def _met(rows: DataFrame, nodes: DataFrame, common: DataFrame) -> DataFrame:
    """rows (a, b, ...) with their nodes' columns; those of common nodes, a bounded number, don't move."""
    few = F.broadcast(common)
    hot = rows.join(few, ["a", "b"])
    return hot.unionByName(rows.join(few, ["a", "b"], "left_anti").join(nodes, ["a", "b"]))


def first_owned(known: DataFrame, nodes: DataFrame, common: DataFrame) -> DataFrame:
    """(conv, size, first): the least depth of which a conversation owns its prefix, size + 1 if none."""
    own, hot = nodes.select("a", "b", "owner"), common.select("a", "b", "owner")
    state = known.groupBy("conv").agg(F.max("depth").alias("size")).select("conv", "size", F.lit(0).cast("long").alias("low"), (F.col("size") + 1).alias("high"))
    state = checkpointed(state)
    while state.where("low < high").limit(1).count():  # as often as the longest conversation has binary digits
        asked = state.where("low < high").select("conv", F.floor((F.col("low") + F.col("high")) / 2).alias("depth"))
        told = _met(asked.join(known.select("conv", "depth", "a", "b"), ["conv", "depth"]), own, hot)
        told = told.select("conv", "depth", (F.col("owner") == F.col("conv")).alias("mine"))
        both = state.join(told, "conv", "left")
        low = F.when(~F.col("mine"), F.col("depth") + 1).otherwise(F.col("low"))
        high = F.when(F.col("mine"), F.col("depth")).otherwise(F.col("high"))
        state = checkpointed(both.select("conv", "size", low.alias("low"), high.alias("high")))
    return state.select("conv", "size", F.col("low").alias("first"))


def _totals(chains: DataFrame) -> DataFrame:
    """(parent, at, n, leaves, saved): what hangs from each node that others hang from.

    chains: conv, parent and at (the node it hangs from; null for the root's chain), saved by its own nodes, and whether
    its last node has nothing below.
    """
    remaining, done = checkpointed(chains.select("conv", "parent", "at", F.col("leaf").alias("leaves"), "saved")), None
    while remaining.limit(1).count():  # as often as chains hang from chains
        parents = remaining.where("parent IS NOT NULL").select(F.col("parent").alias("conv")).distinct()
        ended = checkpointed(remaining.join(parents, "conv", "left_anti"))
        done = ended if done is None else done.unionByName(ended)
        added = ended.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = remaining.join(parents, "conv", "left_semi").join(added, "conv", "left")
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        remaining = checkpointed(rest.select("conv", "parent", "at", *sums))
    done = remaining if done is None else done
    return done.where("parent IS NOT NULL").groupBy("parent", "at").agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


_PIECES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string()), ("digest", pa.string())])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv): the hash of the ids of each node that begins and ends within the task, and the first and last node's ids in stretches."""
    node, ids, first, size, begun = None, [], 0, 0, False

    def told(node: tuple, first: int, ids: list[str], whole: bool) -> pa.RecordBatch:
        text = ",".join(ids)
        digest = hashlib.sha256(text.encode()).hexdigest() if whole else None
        return pa.record_batch([pa.array([x]) for x in (*node, first)] + [pa.array([None if whole else text], pa.string()), pa.array([digest], pa.string())], schema=_PIECES)

    ended: list[tuple] = []  # whole nodes, in batches
    for batch in batches:
        for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv")), strict=True):
            if (a, b) != node:
                if node is not None:
                    if begun:
                        ended.append((*node, first, None, hashlib.sha256(",".join(ids).encode()).hexdigest()))
                    else:
                        yield told(node, first, ids, False)
                begun = node is not None  # the first node of the task may have begun before
                node, ids, first, size = (a, b), [], conv, 0
            if size >= STRETCH:  # a long one goes on in stretches
                yield told(node, first, ids, False)
                ids, first, size, begun = [], conv, 0, False
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if ended:
            yield pa.record_batch([pa.array(list(x), kind) for x, kind in zip(zip(*ended, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
            ended.clear()
    if node is not None:
        yield told(node, first, ids, False)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, first, ids): the hash of each node's ids, put together one stretch at a time."""
    node, hashed = None, hashlib.sha256()
    told = lambda: pa.record_batch([pa.array([x]) for x in (*node, hashed.hexdigest())], names=["a", "b", "digest"])
    for batch in batches:
        for a, b, ids in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (a, b) != node:
                if node is not None:
                    yield told()
                node, hashed = (a, b), hashlib.sha256(ids.encode())
            else:
                hashed.update(b"," + ids.encode())
    if node is not None:
        yield told()


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, digest): SHA-256 of the ids, ascending and joined by commas, of the conversations (a, b, conv) that end at a node."""
    pieces = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    pieces = written(pieces.mapInArrow(tidy(_stretches), "a long, b long, first long, ids string, digest string"), "ends")
    cut = pieces.where("digest IS NULL").select("a", "b", "first", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return pieces.where("digest IS NOT NULL").select("a", "b", "digest").unionByName(cut.mapInArrow(_together, "a long, b long, digest string"))


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """A row a node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text; each is rebuilt first (see `rebuilt`).
    """
    known = written(prefixes(rebuilt(conversations, group, heads)), "prefixes")
    nodes = written(known.groupBy("a", "b").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.max("words").alias("words")), "nodes")
    common = nodes.where(F.col("n_convs") >= max(1, int(HOT * known.count())))
    chains = first_owned(known, nodes, common)
    owning = chains.where("first <= size")
    hung = owning.where("first > 0").select("conv", (F.col("first") - 1).alias("depth")).join(known.select("conv", "depth", "a", "b"), ["conv", "depth"])
    hung = _met(hung, nodes.select("a", "b", "owner"), common.select("a", "b", "owner")).select("conv", F.col("owner").alias("parent"), F.col("depth").alias("at"))
    chains = checkpointed(owning.join(hung, "conv", "left"))  # conv, size, first, parent, at
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    own = nodes.select(F.col("owner").alias("conv"), "depth", "a", "b", "n_convs", saved)
    below = chains.where("parent IS NOT NULL").select(F.col("parent").alias("conv"), F.col("at").alias("size"), F.lit(0).alias("below")).distinct()
    sums = own.groupBy("conv").agg(F.sum("saved").alias("saved"))
    leaf = F.coalesce("below", F.lit(1)).cast("long").alias("leaf")
    totals = _totals(chains.join(below, ["conv", "size"], "left").join(sums, "conv").select("conv", "parent", "at", leaf, "saved"))
    totals = totals.select(F.col("parent").alias("conv"), F.col("at").alias("depth"), "n", F.col("leaves").alias("hung_leaves"), F.col("saved").alias("hung_saved"))
    # a chain's nodes from its last upwards: what each adds itself and what hangs from it
    rows = own.join(chains.select("conv", "size", "first", "parent"), "conv").join(totals, ["conv", "depth"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    last = F.col("depth") == F.col("size")
    adds_leaf = F.when(last & F.col("n").isNull(), 1).otherwise(zero("hung_leaves"))
    rows = rows.select("conv", (F.col("size") - F.col("depth")).alias("depth"), "size", "first", "parent", "a", "b", "n_convs", (zero("n") + F.when(last, 0).otherwise(1)).alias("n_children"), adds_leaf.alias("adds_leaf"), (F.col("saved") + zero("hung_saved")).alias("adds_saved"))
    rows = _summed(rows, {"n_leaves": F.col("adds_leaf"), "saved_tokens": F.col("adds_saved")}).withColumn("depth", F.col("size") - F.col("depth"))
    ends = known.join(chains_ends(known), ["conv", "depth"]).select("a", "b", "conv")
    out = rows.join(end_digests(ends), ["a", "b"], "left")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("parent"))
    return out.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def chains_ends(known: DataFrame) -> DataFrame:
    """(conv, depth) of each conversation's whole length."""
    return known.groupBy("conv").agg(F.max("depth").alias("depth"))
