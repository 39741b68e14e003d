"""Prefix trie of conversations, with subtree totals rolled up in bands of depths.

Conversations that start with the same turns share the nodes of those turns. A node is named
by its depth and 128 bits that mix the content and the place of its turns, so it is found
without comparing texts. Depths are cut into bands of a fixed height. First each node adds
its own figures to its ancestors within its band. Then the bands are finished from the
deepest one upwards: the complete totals of a band's top nodes go to their ancestors in the
band above. A node is copied at most once per level of a band, and there is one round per band.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.plans.scale import numbered, written

BAND = 32
"""Height of a band; tries deeper than its square get bands of the root of their depth."""

PIECE = 1_000
"""Ids that are joined to one piece of text before it is hashed."""

KEY = ["depth", "k1", "k2"]
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def turn_table(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv, pos (from 0), r1, r2, n_bytes for each turn; the texts stay behind.

    `r1, r2` are 128 bits of role and text. Turns are ordered by number, nulls first; equal
    numbers by role and then by the md5 of the text. Null roles and texts are empty. Rows
    without a conv_id are left out; repeated rows are turns of their own.
    """
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        by.alias("role"),
        F.md5(said.cast("binary")).alias("md5"),
        F.xxhash64(by, said).alias("r1"),
        F.xxhash64(F.lit(1), by, said).alias("r2"),
        F.octet_length(said).cast("long").alias("n_bytes"),
    )
    placed = numbered(rows, ["conv"], [F.col("turn").asc_nulls_first(), "role", "md5"], "pos")
    return placed.select("conv", "pos", "r1", "r2", "n_bytes")


def forked(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as forks, and their turns (conv, depth, r1, r2, n_bytes, n_turns).

    Conversation c starts with the first h turns of conversation c - c % every (all if
    fewer, none if absent) and goes on with its own turns after its first h, where h is the
    crc32 of c's decimal digits modulo `most`. The first table has conv and n_turns.
    """
    turns = written(turns)
    counts = written(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    own = counts.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    of_base = counts.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    length = F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    convs = own.join(of_base, "base", "left").withColumn("taken", taken)
    convs = written(convs.select("conv", "base", "h", "taken", length.cast("long").alias("n_turns")))
    content = ["r1", "r2", "n_bytes", "n_turns"]
    heirs = convs.where("taken > 0").select(F.col("base").alias("conv"), F.col("conv").alias("heir"), "taken", "n_turns")
    heads = turns.where(F.col("pos") < most - 1).join(heirs, "conv").where("pos < taken")
    tails = turns.join(convs.select("conv", "h", "taken", "n_turns"), "conv").where("pos >= h")
    rebuilt = heads.select(F.col("heir").alias("conv"), (F.col("pos") + 1).cast("long").alias("depth"), *content)
    rebuilt = rebuilt.unionByName(
        tails.select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).cast("long").alias("depth"), *content)
    )
    return convs.select("conv", "n_turns"), written(rebuilt)


def node_rows(turns: DataFrame, band: int) -> DataFrame:
    """conv, KEY, chain, n_bytes, n_turns: the node that each turn of each conversation leads to.

    `chain` has the keys of its ancestors from the top of the band down to its parent. The
    key of a band's top is an exclusive-or over bands, so a long conversation is split.
    """
    salted = [F.xxhash64(*extra, "depth", "r1", "r2") for extra in ((), (F.lit(1),))]
    rows = turns.select(
        "conv", "depth", F.floor((F.col("depth") - 1) / band).alias("band"), "n_bytes", "n_turns",
        salted[0].alias("t1"), salted[1].alias("t2"),
    )
    totals = rows.groupBy("conv", "band").agg(F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"))
    above = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    top = [F.coalesce(F.bit_xor(t).over(above), F.lit(0)).alias(b) for t, b in (("t1", "b1"), ("t2", "b2"))]
    tops = written(totals.select("conv", "band", *top))
    order = Window.partitionBy("conv", "band").orderBy("depth")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    named = rows.join(tops, ["conv", "band"]).select(
        "conv", "band", "depth", "n_bytes", "n_turns", "b1", "b2",
        F.col("b1").bitwiseXOR(F.bit_xor("t1").over(so_far)).alias("k1"),
        F.col("b2").bitwiseXOR(F.bit_xor("t2").over(so_far)).alias("k2"),
    )
    before = F.collect_list(F.struct("k1", "k2")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.concat(F.array(F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2"))), before)
    return named.select("conv", *KEY, chain.alias("chain"), "n_bytes", "n_turns")


def trie_nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """KEY, conv_id (smallest member), n_convs, n_bytes, deepest (turns of a member), chain."""
    figures = [F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("n_turns").alias("deepest")]
    nodes = rows.groupBy(*KEY).agg(*figures, F.max("n_bytes").alias("n_bytes"), F.any_value("chain").alias("chain"))
    zero = F.lit(0).cast("long")
    root = convs.agg(*figures).where("n_convs > 0").select(
        *[zero.alias(c) for c in KEY], "n_convs", "conv_id", "deepest", zero.alias("n_bytes"),
        F.filter(F.array(F.struct(zero.alias("k1"), zero.alias("k2"))), lambda _: F.lit(False)).alias("chain"),
    )
    return nodes.unionByName(root)


def added(items: DataFrame, gifts: Column) -> DataFrame:
    """Sums of TOTALS per node from an array of (KEY, TOTALS) in each row; combines map-side."""
    given = items.select(F.inline(gifts))
    return given.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in TOTALS])


def gift(depth: Column, key: Column, children: Column, leaves: Column, saved: Column) -> Column:
    parts = (depth, key["k1"], key["k2"], children, leaves, saved)
    return F.struct(*[p.cast("long").alias(c) for p, c in zip(parts, KEY + TOTALS, strict=True)])


def subtree_totals(nodes: DataFrame, band: int, deepest: int) -> DataFrame:
    """TOTALS per node: children, leaves of its subtree, and bytes saved in it."""
    zero = F.lit(0)
    own = nodes.withColumns(
        {
            "n_leaves": (F.col("deepest") == F.col("depth")).cast("long"),
            "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes"),
            "first": F.col("depth") - F.size("chain"),
        }
    )
    itself = F.struct("k1", "k2")
    of_self = gift(F.col("depth"), itself, zero, F.col("n_leaves"), F.col("saved_tokens"))
    # the top node of the band below waits for its round, but is a child at once
    waits = F.size("chain") == band

    def for_ancestor(key: Column, i: Column) -> Column:
        child = (i == F.size("chain") - 1).cast("long")
        share = lambda c: F.when(waits, zero).otherwise(F.col(c))
        return gift(F.col("first") + i, key, child, share("n_leaves"), share("saved_tokens"))

    heirs = F.when(waits, F.slice(F.transform("chain", for_ancestor), -1, 1)).otherwise(F.transform("chain", for_ancestor))
    sums = written(added(own, F.concat(F.array(of_self), heirs)))
    parts, tops = [sums], own.where(waits)
    for level in range(deepest // band * band, 0, -band):
        here = [part.where(F.col("depth") == level) for part in {id(p): p for p in (sums, parts[-1])}.values()]
        complete = reduce(DataFrame.unionByName, here).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in TOTALS])
        done = tops.where(F.col("depth") == level).select(*KEY, "chain", "first").join(complete, KEY)
        handed = F.transform(
            "chain", lambda key, i: gift(F.col("first") + i, key, zero, F.col("n_leaves"), F.col("saved_tokens"))
        )
        parts.append(written(added(done, handed)))
    return reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in TOTALS])


def id_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Comma-joined ids, up to `PIECE` of one node, from rows sorted by node and id."""
    for batch in batches:
        new = (batch[KEY] != batch[KEY].shift()).any(axis=1).cumsum()
        groups = batch.groupby([new, batch.groupby(new).cumcount() // PIECE], sort=False)
        out = groups.agg({**dict.fromkeys(KEY, "first"), "conv": ["first", lambda ids: ",".join(map(str, ids))]})
        out.columns = [*KEY, "conv", "ids"]
        yield out


def id_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the pieces of each node, which arrive in order and are not kept."""
    node, state = None, None
    for batch in batches:
        keys, digests = [], []
        for *key, ids in batch[[*KEY, "ids"]].itertuples(index=False):
            if key == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                keys.append(node)
                digests.append(state.hexdigest())
            node, state = key, hashlib.sha256(ids.encode())
        if keys:
            yield pd.DataFrame(keys, columns=KEY).assign(ends_sha256=digests)
    if node is not None:
        yield pd.DataFrame([node], columns=KEY).assign(ends_sha256=[state.hexdigest()])


def end_digests(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256: the hash of the ascending, comma-joined ids (conv) of each node.

    Ids are sorted by range over all tasks, so those of one node are joined in many tasks.
    The hash itself reads the pieces one after another, as SHA-256 must, and keeps none.
    """
    schema = "depth long, k1 long, k2 long"
    ends = written(ends)
    sorted_ids = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    pieces = sorted_ids.mapInPandas(id_pieces, f"{schema}, conv long, ids string")
    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "conv")
    return dealt.mapInPandas(id_digests, f"{schema}, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, band: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations (conv, n_turns) with turns (conv, depth, r1, r2, n_bytes, n_turns).

    conv_id (smallest member), depth, parent_conv_id (of the parent; null for the root),
    n_convs, n_children, n_leaves (of its subtree), saved_tokens (bytes of last texts that
    its subtree saves), ends_sha256 (of the members that end here). The root, depth 0, is
    there whenever a conversation is; without any there are no rows.
    """
    convs, turns = written(convs), written(turns)
    deepest = convs.agg(F.max("n_turns")).first()[0] or 0
    band = band or max(BAND, math.isqrt(deepest) + 1)
    rows = written(node_rows(turns, band))
    nodes = written(trie_nodes(convs, rows))
    totals = subtree_totals(nodes, band, deepest)
    zero = F.lit(0).cast("long")
    ends = rows.where("depth = n_turns").select(*KEY, "conv")
    ends = ends.unionByName(convs.where("n_turns = 0").select(*[zero.alias(c) for c in KEY], "conv"))
    digests = written(end_digests(ends))
    parent = F.element_at("chain", -1)
    full = nodes.join(written(totals), KEY).join(digests, KEY, "left").select(
        "conv_id", "depth", "n_convs", *TOTALS,
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        F.when(F.size("chain") > 0, F.struct((F.col("depth") - 1).alias("depth"), parent["k1"].alias("k1"), parent["k2"].alias("k2"))).alias("up"),
    )
    above = written(nodes.where("deepest > depth").select(F.struct(*KEY).alias("up"), F.col("conv_id").alias("parent_conv_id")))
    return written(full).join(above, "up", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *TOTALS, "ends_sha256"
    )
