"""Exact top-k inner products over a vector-approximation file.

Each component is kept as a cell number. A scan of the cells bounds every score; exact
vectors are then read from the most promising bound downwards, until the k-th score found
is above all bounds that are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import parts
from veilframe.plans.scale import written

CELL = 2
"""Width of a cell. Bounds are off by half of it (less 1/2) per component."""

STEP = 64
"""Exact vectors that are read at once."""


def finite_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """`id` and `vec` of the rows that take part: no null, no non-finite component.

    Rows that repeat an id count once, with the smallest vector; rows without an id are left out.
    """
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    rows = df.where(F.col(vec_id).isNotNull() & fine)
    doubles = F.transform(x, lambda c: c.cast("double"))
    return rows.groupBy(F.col(vec_id).cast("long").alias("id")).agg(F.min(doubles).alias("vec"))


def quantised(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda c: F.floor(c * F.lit(float(scale))))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Each different `vec` once, as `uid` (its smallest id), with its `keep` smallest ids.

    Equal vectors have equal scores, and ties go to smaller ids, so no other id of a
    vector can be among the `keep` best. Ids are cut before the shuffle, so a vector that
    many rows share costs `keep` rows per task.
    """
    order = Window.partitionBy("vec").orderBy("id")
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("uid"), "vec", "ids"
    )


def in_blocks(df: DataFrame, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
    """Deal rows to blocks by `uid`, and repeat them for each block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64("uid"), F.lit(own_parts)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1)))
    )


def refine(query: np.ndarray, exact: np.ndarray, around: np.ndarray, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the rows that can be among the k best for one query.

    `around` is the score at the centre of each row's cells; the true one is at most
    `slack` away. Rows that tie with the k-th are all returned.
    """
    n = len(around)
    if n > k:
        near = np.flatnonzero(around >= np.partition(around, n - k)[n - k] - 2 * slack)
    else:
        near = np.arange(n)
    near = near[np.argsort(-around[near], kind="stable")]
    scores = np.empty(len(near), np.int64)
    done, kth = 0, None
    while done < len(near) and (kth is None or around[near[done]] + slack >= kth):
        step = near[done : done + STEP]
        scores[done : done + len(step)] = exact[step] @ query
        done += len(step)
        if done >= k:
            kth = np.partition(scores[:done], done - k)[done - k]
    places, scores = near[:done], scores[:done]
    if kth is not None:
        best = scores >= kth
        places, scores = places[best], scores[best]
    return places, scores


def search_block(queries: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    cells = (vectors // CELL).astype(np.int16 if np.abs(vectors).max(initial=0) < 60_000 else np.int64)
    centres = cells * float(CELL) + (CELL - 1) / 2
    found = []
    for at in range(0, len(queries), 128):
        some = queries[at : at + 128]
        around = some.astype(np.float64) @ centres.T
        slack = np.abs(some).sum(axis=1) * ((CELL - 1) / 2)
        found += [refine(q, vectors, a, s, k) for q, a, s in zip(some, around, slack, strict=True)]
    return found


def top_k(rows: DataFrame, is_query: Column, k: int, block: int = 16_384, query_block: int = 2_048) -> DataFrame:
    """For each query among `rows` (id, integer vec) its k best other rows: query_id, rank, vec_id, score.

    Ties go to the smaller id. Only vectors of equal length meet. Blocks of queries meet
    blocks of vectors, both of bounded size; each block pair returns k + 1 rows per query,
    and those are cut again before they are shuffled. An empty table, or one without
    queries, gives no rows; scores must fit 53 bits.
    """
    rows = written(rows)
    vectors = written(distinct_vectors(rows, k + 1))
    asked = rows.where(is_query)
    queries = written(asked.groupBy("vec").agg(F.min("id").alias("uid")))
    n_vectors, n_queries = parts(vectors.count(), block), parts(queries.count(), query_block)
    left = in_blocks(queries.withColumn("size", F.size("vec")), "qb", n_queries, "vb", n_vectors)
    right = in_blocks(vectors.withColumn("size", F.size("vec")), "vb", n_vectors, "qb", n_queries)
    pairs = left.groupBy("size", "qb", "vb").cogroup(right.groupBy("size", "qb", "vb"))

    def search(key: tuple, few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        uids, ids, scores = [], [], []
        if len(few) and len(many):
            asked_, stored = np.stack(few["vec"].to_numpy()), np.stack(many["vec"].to_numpy())
            members = many["ids"].to_numpy()
            for uid, (places, found) in zip(few["uid"], search_block(asked_, stored, k + 1), strict=True):
                own = np.concatenate([members[p] for p in places])
                score = np.repeat(found, [len(members[p]) for p in places])
                best = np.lexsort((own, -score))[: k + 1]
                uids.append(np.full(len(best), uid))
                ids.append(own[best])
                scores.append(score[best])
        empty = [np.empty(0, np.int64)]
        return pd.DataFrame(
            {n: np.concatenate(v or empty) for n, v in (("uid", uids), ("vec_id", ids), ("score", scores))}
        )

    found = pairs.applyInPandas(search, "uid long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    lists = best.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("list")
    )
    named = asked.join(queries.select("vec", "uid"), "vec").select(F.col("id").alias("query_id"), "uid")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = named.join(lists, "uid").select("query_id", F.posexplode(others).alias("at", "hit"))
    return ranked.select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.s")).alias("score"),
    )
