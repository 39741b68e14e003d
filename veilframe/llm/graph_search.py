"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

A shard's graph is a few flat arrays: unit vectors ordered so that members of higher levels
come first, the number of nodes per level, and a neighbour array per level (-1: free place).
All nodes of a batch are searched at once; per-node Python loops are not needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import parts
from veilframe.llm.exact_search import distinct_vectors, in_blocks
from veilframe.plans.scale import written

LINKS = 16
"""Neighbours that a new node gets; a node keeps twice as many at most."""

BUILD_BEAM = 64
SEARCH_BEAM = 96
WIDTH = 4
"""Nodes of a beam that are opened in one step."""

LEVEL_RATE = 16
"""Each level has about so many times the nodes of the next."""


def beam_search(
    unit: np.ndarray, links: np.ndarray, asked: np.ndarray, start: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` best nodes found for each row of `asked`: ids (-1: none) and similarities, best first."""
    rows, n = len(asked), len(links)
    seen = np.zeros((rows, n + 1), bool)
    seen[:, n] = True  # stands for free places
    ids = np.full((rows, beam), n)
    ids[:, : start.shape[1]] = np.where(start < 0, n, start)[:, :beam]
    np.put_along_axis(seen, ids, True, 1)
    near = np.einsum("rbd,rd->rb", unit[np.minimum(ids, n - 1)], asked)
    near[ids == n] = -np.inf
    opened = ids == n
    active = np.arange(rows)
    while len(active):
        score = np.where(opened[active], -np.inf, near[active])
        width = min(WIDTH, beam)
        pick = np.argpartition(-score, width - 1, axis=1)[:, :width]
        live = np.take_along_axis(score, pick, 1) > -np.inf
        more = live.any(axis=1)
        active, pick, live = active[more], pick[more], live[more]
        if not len(active):
            break
        opened[active[:, None], pick] = True
        nodes = np.where(live, ids[active[:, None], pick], n)
        fresh = np.where(nodes[:, :, None] < n, links[np.minimum(nodes, n - 1)], -1).reshape(len(active), -1)
        fresh = np.sort(np.where(fresh < 0, n, fresh), axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        met = active[:, None], fresh
        fresh = np.where(seen[met], n, fresh)
        seen[active[:, None], fresh] = True
        some = np.einsum("rbd,rd->rb", unit[np.minimum(fresh, n - 1)], asked[active])
        some[fresh == n] = -np.inf
        all_ids = np.concatenate([ids[active], fresh], axis=1)
        all_near = np.concatenate([near[active], some], axis=1)
        all_open = np.concatenate([opened[active], fresh == n], axis=1)
        best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        near[active] = np.take_along_axis(all_near, best, 1)
        opened[active] = np.take_along_axis(all_open, best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    return np.where(near > -np.inf, ids, -1), near


def spread_out(unit: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Choose up to `most` neighbours per row: nearest first, but none that is nearer to a chosen
    one than to the node itself; free places are then filled with the nearest left out."""
    rows, n = ids.shape
    place = np.maximum(ids, 0)
    between = np.einsum("rad,rbd->rab", unit[place], unit[place])
    chosen = np.zeros((rows, n), bool)
    closest = np.full((rows, n), -np.inf)  # to any chosen neighbour
    for at in range(n):
        take = (ids[:, at] >= 0) & (closest[:, at] < near[:, at]) & (chosen.sum(axis=1) < most)
        chosen[:, at] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, at]), closest)
    rank = np.where(ids < 0, 2 * n, np.where(chosen, 0, n)) + np.arange(n)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)


def add_back_links(unit: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Enter each new node at its neighbours; full places keep their nearest."""
    source = np.repeat(new, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, first, count = np.unique(target, return_index=True, return_counts=True)
    if not len(touched):
        return
    slot = np.arange(len(target)) - np.repeat(first, count)
    fresh = np.full((len(touched), count.max()), -1)
    fresh[np.repeat(np.arange(len(touched)), count), slot] = source
    both = np.concatenate([links[touched], fresh], axis=1)
    near = np.einsum("rbd,rd->rb", unit[np.maximum(both, 0)], unit[touched])
    near[both < 0] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : links.shape[1]]
    links[touched] = np.where(
        np.take_along_axis(near, best, 1) > -np.inf, np.take_along_axis(both, best, 1), -1
    )


def descend(unit: np.ndarray, levels: list[np.ndarray], asked: np.ndarray, down_to: int) -> np.ndarray:
    """Entry points for level `down_to`, from the top level by small beams."""
    start = np.zeros((len(asked), 1), np.int64)
    for links in reversed(levels[down_to + 1 :]):
        start = beam_search(unit, links, asked, start, 8)[0]
    return start


def build_graph(unit: np.ndarray, level_sizes: list[int]) -> list[np.ndarray]:
    """Neighbour arrays per level, lowest first. Nodes 0..size-1 belong to a level of that size."""
    levels = [np.full((size, 2 * LINKS), -1) for size in level_sizes]
    done = 1
    while done < len(unit):
        new = np.arange(done, min(len(unit), done + min(256, done)))
        top = max(i for i, size in enumerate(level_sizes) if size > done)
        new = new[new < level_sizes[top]]  # so the nodes of a batch have the same top level
        view = [x[:done] for x in levels]
        found = [
            beam_search(unit, view[level], unit[new], descend(unit, view, unit[new], level), BUILD_BEAM)
            for level in range(top + 1)
        ]
        mates = unit[new] @ unit[new].T
        mates[np.arange(len(new))[:, None] <= np.arange(len(new))] = -np.inf
        for links, (ids, near) in zip(levels, found):
            ids = np.concatenate([ids, np.where(mates > -np.inf, new[None], -1)], axis=1)
            near = np.concatenate([near, mates], axis=1)
            best = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, near = np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1)
            chosen = spread_out(unit, np.where(near > -np.inf, ids, -1), near, LINKS)
            links[new, : chosen.shape[1]] = chosen
            add_back_links(unit, links, new, chosen)
        done += len(new)
    return levels


def level_sizes(n: int) -> list[int]:
    sizes = [n]
    while sizes[-1] > LEVEL_RATE:
        sizes.append(sizes[-1] // LEVEL_RATE)
    return sizes


GRAPH = "shard int, size int, uids array<long>, units binary, level_sizes array<int>, links binary"


def build_index(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """One row per shard and vector length: the graph as flat arrays.

    Rows are dealt to shards, and ordered for levels, by a hash of their id.
    """
    n = parts(vectors.count(), shard_rows)
    dealt = vectors.select(
        F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias("shard"),
        F.size("vec").alias("size"),
        "uid",
        "vec",
        F.xxhash64(F.lit("level"), "uid").alias("order"),
    )

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order")
        raw = np.stack(rows["vec"].to_numpy())
        # divide by the largest component first, so that squares stay finite
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
        sizes = level_sizes(len(unit))
        links = np.concatenate([x.ravel() for x in build_graph(unit, sizes)]).astype(np.int32)
        return pd.DataFrame(
            {
                "shard": [rows["shard"].iloc[0]],
                "size": [rows["size"].iloc[0]],
                "uids": [rows["uid"].to_numpy()],
                "units": [unit.tobytes()],
                "level_sizes": [sizes],
                "links": [links.tobytes()],
            }
        )

    return dealt.groupBy("size", "shard").applyInPandas(build, GRAPH)


def search_graph(graph: pd.Series, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    unit = np.frombuffer(graph["units"], np.float32).reshape(len(graph["uids"]), -1)
    flat, levels, at = np.frombuffer(graph["links"], np.int32), [], 0
    for size in graph["level_sizes"]:
        levels.append(flat[at : at + size * 2 * LINKS].reshape(size, -1))
        at += size * 2 * LINKS
    raw = asked / np.abs(asked).max(axis=1, keepdims=True)
    asked = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
    return beam_search(unit, levels[0], asked, descend(unit, levels, asked, 0), beam)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows get equal results wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int,
    shard_rows: int = 4_096,
    query_block: int = 1_024,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """For each query among `rows` (id, vec of doubles) k near other rows by cosine.

    Zero vectors take no part, and only vectors of equal length meet. Equal vectors are one
    node; their k + 1 smallest ids go with it, which is all that ties can return. Each
    shard returns its best nodes with the exact cosine; shards are merged by that score and
    then by id. An empty table, or one without queries, gives no rows.
    """
    rows = written(rows.where(F.exists("vec", lambda c: c != 0)))
    vectors = written(distinct_vectors(rows, k + 1))
    index = written(build_index(vectors, shard_rows))
    asked = rows.where(is_query)
    queries = written(asked.groupBy("vec").agg(F.min("id").alias("uid")))
    n_queries = parts(queries.count(), query_block)
    shards = int(index.agg(F.max("shard")).first()[0] or 0) + 1
    left = in_blocks(queries.withColumn("size", F.size("vec")), "qb", n_queries, "shard", shards)
    right = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    pairs = left.groupBy("size", "qb", "shard").cogroup(right.groupBy("size", "qb", "shard"))

    def search(few: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        if not len(few) or not len(graphs):
            return pd.DataFrame({"uid": np.empty(0, np.int64), "node": np.empty(0, np.int64)})
        graph = graphs.iloc[0]
        ids, near = search_graph(graph, np.stack(few["vec"].to_numpy()), beam)
        ids = ids[:, : 2 * (k + 1)]
        uids = np.asarray(graph["uids"])
        hit = ids >= 0
        return pd.DataFrame(
            {"uid": np.repeat(few["uid"].to_numpy(), hit.sum(axis=1)), "node": uids[ids[hit]]}
        )

    found = pairs.applyInPandas(search, "uid long, node long")
    stored = vectors.select(F.col("uid").alias("node"), F.col("vec").alias("near"), "ids")
    met = found.join(stored, "node").join(queries, "uid")

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        sizes = a.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            out[at] = cosine(np.stack(a.to_numpy()[at]), np.stack(b.to_numpy()[at]))
        return pd.Series(out)

    scored = met.select("uid", score("vec", "near").alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    best = scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    lists = best.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("list")
    )
    named = asked.join(queries, "vec").select(F.col("id").alias("query_id"), "uid")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = named.join(lists, "uid").select("query_id", F.posexplode(others).alias("at", "hit"))
    return ranked.select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.s")).alias("score"),
    )
