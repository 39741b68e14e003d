"""Hard negatives by a vertical scan of vectors, with bounds from what is left to read.

A block of rows is stored dimension by dimension. Each anchor reads the dimensions in the
order of its own falling magnitudes. After every few of them, the least and greatest that
the unread dimensions can still add bound each row's score, and rows that cannot matter any
more leave the candidate bitmap. The few that stay are read in full. Rows of a block are
sorted by label, and the least and greatest value of a dimension are known per label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import parts
from veilframe.plans.scale import written

STEP = 8
"""Dimensions that are read before the bitmap is shrunk again."""

FEW = 64
"""Candidates that are read in full at once."""

EXACT = 2**53
"""Scores are whole numbers below this, so sums of doubles are exact."""


def labelled_vectors(df: DataFrame, scale: int, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """id, label, vec (whole numbers, floor(scale * x)) and key of the rows that take part.

    Left out are rows without id, label or vector, and vectors with a null or non-finite
    component. Rows that agree in all three count once; a further row of the same id is a
    row of its own, though never a partner of that id.
    """
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & fine)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("vec"))
    return rows.withColumn("key", F.xxhash64("id", "label", "vec")).dropDuplicates(["id", "label", "vec"])


class Columns:
    """The vectors of a block as columns, with the range of each column per label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T, np.float64)
        self.labels, self.starts = np.unique(labels[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))
        self.low = np.minimum.reduceat(self.columns, self.starts, axis=1)
        self.high = np.maximum.reduceat(self.columns, self.starts, axis=1)
        self.read = self.all = 0

    def rest(self, query: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per label, the least and the most that dimensions order[i:] can add, for each i."""
        one, two = query[order, None] * self.low[order], query[order, None] * self.high[order]
        sums = [np.cumsum(x[::-1], axis=0)[::-1] for x in (np.minimum(one, two), np.maximum(one, two))]
        none = np.zeros((1, len(self.labels)))
        return np.vstack([sums[0], none]), np.vstack([sums[1], none])

    def scan(self, query: np.ndarray, alive: np.ndarray, label: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the rows of `alive` that `shrink(least, most)` does not rule out.

        `label` is the number of each row's label. Bounds are equal to the score at the end.
        """
        order = np.argsort(-np.abs(query), kind="stable")
        least, most = self.rest(query, order)
        partial = np.zeros(len(alive))
        self.all += len(alive) * len(order)
        at = 0
        while at < len(order):
            step = order[at : at + STEP] if len(alive) > FEW else order[at:]
            full = len(alive) == self.columns.shape[1]
            for d in step:
                column = self.columns[d]
                partial += query[d] * (column if full else column[alive])
            at += len(step)
            self.read += len(alive) * len(step)
            keep = shrink(partial + least[at][label], partial + most[at][label])
            if not keep.all():
                alive, label, partial = alive[keep], label[keep], partial[keep]
        return alive, partial.astype(np.int64)

    def rows_of(self, label: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places, and numbers of labels, of the rows that have the label, or have another."""
        same = np.flatnonzero(self.labels == label)
        start, end = (self.starts[same[0]], self.ends[same[0]]) if len(same) else (0, 0)
        which = np.repeat(np.arange(len(self.labels)), self.ends - self.starts)
        at = np.arange(start, end) if own else np.concatenate([np.arange(start), np.arange(end, len(self.ids))])
        return at, which[at]


def kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def nearest_of_label(block: Columns, anchor_id: int, label: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of the anchor's label."""
    at, of = block.rows_of(label, own=True)
    other = block.ids[at] != anchor_id
    at, scores = block.scan(query, at[other], of[other], lambda least, most: most >= kth_largest(least, k))
    best = best_first(block.ids[at], scores, k)
    return block.ids[at][best], scores[best]


def best_in_windows(
    block: Columns, anchor_id: int, label: int, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window, ids and scores of the k best rows of other labels whose score lies in it."""

    def shrink(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(least), bool)
        for a, b in zip(low, high, strict=True):
            inside = least[(least >= a) & (most <= b)]  # certainly in the window
            keep |= (most >= max(a, kth_largest(inside, k))) & (least <= b)
        return keep

    at, of = block.rows_of(label, own=False)
    other = block.ids[at] != anchor_id
    at, scores = block.scan(query, at[other], of[other], shrink)
    out = []
    for a, b in zip(low, high, strict=True):
        fits = np.flatnonzero((scores >= a) & (scores <= b))
        fits = fits[best_first(block.ids[at[fits]], scores[fits], k)]
        out.append((block.ids[at[fits]], scores[fits]))
    return out


def met_in_blocks(anchors: DataFrame, rows: DataFrame, block: int, anchor_block: int):
    """Groups (size, ab, vb): a block of anchors and a block of vectors, each block pair once."""
    n_rows, n_anchors = parts(rows.count(), block), parts(anchors.count(), anchor_block)

    def dealt(df: DataFrame, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
        number = F.pmod(F.xxhash64("key"), F.lit(own_parts)).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1)))
        return df.withColumn("size", F.size("vec")).withColumn(own, number).withColumn(other, met)

    left = dealt(anchors, "ab", n_anchors, "vb", n_rows).groupBy("size", "ab", "vb")
    return left.cogroup(dealt(rows, "vb", n_rows, "ab", n_anchors).groupBy("size", "ab", "vb"))


def block_of(rows: pd.DataFrame) -> Columns:
    return Columns(rows["id"].to_numpy(), rows["label"].to_numpy(), np.stack(rows["vec"].to_numpy()))


def stacked(anchors: pd.DataFrame, block: Columns) -> np.ndarray:
    queries = np.stack(anchors["vec"].to_numpy()).astype(np.float64)
    if (np.abs(queries).max(axis=0, initial=0) * np.abs(block.columns).max(axis=1, initial=0)).sum() >= EXACT:
        raise OverflowError("scores of 2^53 and more are not exact")
    return queries


def table_of(names: list[str], parts_: list[tuple]) -> pd.DataFrame:
    """One table from pieces (scalar or array per column)."""
    sizes = [max((len(x) for x in p if isinstance(x, np.ndarray)), default=1) for p in parts_]
    none = [np.empty(0, np.int64)]
    return pd.DataFrame(
        {
            name: np.concatenate([np.broadcast_to(p[i], n) for p, n in zip(parts_, sizes, strict=True)] or none)
            for i, name in enumerate(names)
        }
    )


def positives(rows: DataFrame, anchors: DataFrame, k: int, block: int, anchor_block: int) -> DataFrame:
    """key (of the anchor), positive_id, positive_score: the k best other rows of each anchor's label."""

    def search(key: tuple, some: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(some) and len(many):
            columns = block_of(many)
            for a, query in zip(some.itertuples(), stacked(some, columns), strict=True):
                ids, scores = nearest_of_label(columns, a.id, a.label, query, k)
                found.append((a.key, ids, scores))
        return table_of(["key", "positive_id", "positive_score"], found)

    pairs = met_in_blocks(anchors, rows, block, anchor_block)
    found = pairs.applyInPandas(search, "key long, positive_id long, positive_score long")
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, k: int = 5, wanted: int = 3, low: int = 50, high: int = 95,
    block: int = 16_384, anchor_block: int = 2_048,
) -> DataFrame:
    """For each anchor among `rows` (id, label, vec, key) and each of its k positives, its hard negatives.

    Positives are the best other rows of the anchor's label by inner product. Negatives are
    the first `wanted` rows of other labels with a score of `low` to `high` per cent of the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    Higher scores come first, ties by smaller id; fewer rows come back where there are
    fewer. Only vectors of equal length meet. Tables that are empty or without anchors give
    no rows. Scores must fit 53 bits, else the run fails.
    """
    rows = written(rows)
    anchors = written(rows.where(is_anchor))
    near = written(positives(rows, anchors, k, block, anchor_block))
    # the bounds are whole numbers, so the windows need no fractions
    bounds = near.withColumns(
        {
            "low": F.ceil(F.col("positive_score") * low / F.lit(100)).cast("long"),
            "high": F.floor(F.col("positive_score") * high / F.lit(100)).cast("long"),
        }
    ).where("low <= high")
    lists = bounds.groupBy("key").agg(
        F.collect_list("positive_id").alias("ids"), F.collect_list("positive_score").alias("scores"),
        F.collect_list("low").alias("low"), F.collect_list("high").alias("high"),
    )
    asking = written(anchors.join(lists, "key"))

    def search(key: tuple, some: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(some) and len(many):
            columns = block_of(many)
            for a, query in zip(some.itertuples(), stacked(some, columns), strict=True):
                # equal scores have equal windows
                score, first = np.unique(a.scores, return_index=True)
                hits = best_in_windows(columns, a.id, a.label, query, a.low[first], a.high[first], wanted)
                of = dict(zip(score.tolist(), hits, strict=True))
                found += [(a.key, a.id, p, s, *of[s]) for p, s in zip(a.ids, a.scores, strict=True)]
        names = ["key", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return table_of(names, found)

    pairs = met_in_blocks(asking, rows, block, anchor_block)
    schema = "key long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = pairs.applyInPandas(search, schema)
    order = Window.partitionBy("key", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
