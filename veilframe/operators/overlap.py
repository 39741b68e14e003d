"""Overlap of boxes: similar pairs and non-maximum suppression.

Two boxes whose overlap ratio exceeds a threshold have similar sizes and nearby corners.
That bounds which grid cells can hold a partner, so large groups are joined by cell
instead of pair by pair.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.geometry import has_area, intersection, overlaps_above, union
from veilframe.operators.detections import confident
from veilframe.plans.scale import FOLD_LIMIT, hot_keys, joined, same_keys, tidy, written

GROUP = ["image_id", "class_id"]
BOX = ["image_id", "class_id", "det_id", "score", "x0", "y0", "x1", "y1"]
CELL = ["_lx", "_ly", "_cx", "_cy"]
PAIR_LIMIT = 256
"""Largest group whose boxes are compared pair by pair."""

ROUND_FOLDS = 8
"""Groups that folds alone would need more rounds than this for use cell leaders too."""


def _check_iou(iou: float) -> None:
    if not 0 < iou <= 1:
        raise ValueError(f"iou must lie in (0, 1], got {iou!r}")


class _Grid:
    """Cells that find every partner of a box.

    Partners have side ratios of at least `ratio`, and their upper left corners differ,
    along each axis, by less than `reach` times the side of the one that starts first.
    Each box lives in one cell of the grid for its own size level; probing covers all
    cells a partner may be in.
    """

    def __init__(self, ratio: float, reach: float) -> None:
        # slightly wider than required, so that rounding never hides a partner
        self.base = 1.0 / (ratio * 0.999)
        self.reach = reach * 1.001 + 1e-9

    def _level(self, side: Column) -> Column:
        return F.floor(F.log(side.cast("double")) / F.lit(math.log(self.base))).cast("int")

    def _step(self, level: Column) -> Column:
        """Cell side at a level: the reach of the largest box of that level."""
        return F.lit(self.reach) * F.pow(F.lit(self.base), level + F.lit(1))

    def home(self, boxes: DataFrame) -> DataFrame:
        lx, ly = self._level(F.col("x1") - F.col("x0")), self._level(F.col("y1") - F.col("y0"))
        return boxes.withColumns(
            {
                "_lx": lx,
                "_ly": ly,
                "_cx": F.floor(F.col("x0") / self._step(lx)),
                "_cy": F.floor(F.col("y0") / self._step(ly)),
            }
        )

    def probe(self, boxes: DataFrame) -> DataFrame:
        out = boxes
        for axis in ("x", "y"):
            low, side = F.col(f"{axis}0"), F.col(f"{axis}1") - F.col(f"{axis}0")
            level, cell = f"_l{axis}", f"_c{axis}"
            mid = self._level(side)
            out = out.withColumn(level, F.explode(F.array(mid - 1, mid, mid + 1)))
            step = self._step(F.col(level))
            # the gap is within the reach of whichever box starts first: a partner of this
            # level is at most one step before, or this box's own reach behind
            behind = F.lit(self.reach) * side.cast("double")
            cells = F.sequence(F.floor((low - step) / step), F.floor((low + behind) / step))
            out = out.withColumn(cell, F.explode(cells))
        return out


def _packed(df: DataFrame, name: str, extra: list[str]) -> DataFrame:
    fields = [c for c in df.columns if c not in GROUP + extra]
    return df.select(*GROUP, *extra, F.struct(*fields).alias(name))


def _same(a: str, b: str, keys: list[str]) -> Column:
    return same_keys(a, b, keys)


def iou_pairs(boxes: DataFrame, iou: float, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Pairs of boxes of one image and class whose overlap ratio exceeds `iou`.

    Exact copies are merged first: a row stands for two distinct shapes, named by their
    lowest `det_id`, and `pairs` says how many pairs of boxes it covers. A shape that
    occurs more than once also has a row with itself.
    """
    _check_iou(iou)
    shape = [*GROUP, "x0", "y0", "x1", "y1"]
    shapes = written(
        boxes.where(has_area())
        .groupBy(*shape)
        .agg(F.min("det_id").alias("det_id"), F.count(F.lit(1)).alias("copies"))
    )
    hot = hot_keys(shapes, GROUP, pair_limit)
    if hot is None:
        parts = [_pairs_by_group(shapes, iou)]
    else:
        parts = [
            _pairs_by_group(joined(shapes, hot, GROUP, "left_anti"), iou),
            _pairs_by_cell(joined(shapes, hot, GROUP, "left_semi"), iou),
        ]
    same = shapes.where((F.col("copies") > 1) & F.lit(iou < 1)).select(
        *GROUP,
        F.col("det_id").alias("det_a"),
        F.col("det_id").alias("det_b"),
        F.lit(1.0).alias("iou"),
        (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("pairs"),
    )
    return reduce(DataFrame.unionByName, [*parts, same])


def _pair_row(a: str, b: str) -> list[Column]:
    return [
        F.col(f"{a}.det_id").alias("det_a"),
        F.col(f"{b}.det_id").alias("det_b"),
        (intersection(a, b).cast("double") / union(a, b)).alias("iou"),
        (F.col(f"{a}.copies") * F.col(f"{b}.copies")).alias("pairs"),
    ]


def _pairs_by_group(shapes: DataFrame, iou: float) -> DataFrame:
    a, b = _packed(shapes, "a", []), _packed(shapes, "b", [])
    rule = (F.col("a.det_id") < F.col("b.det_id")) & overlaps_above("a", "b", iou)
    return a.join(b, GROUP).where(rule).select(*GROUP, *_pair_row("a", "b"))


def _pairs_by_cell(shapes: DataFrame, iou: float) -> DataFrame:
    grid = _Grid(iou, 1.0 - iou)
    a, b = _packed(grid.probe(shapes), "a", CELL), _packed(grid.home(shapes), "b", CELL)
    rule = (F.col("a.det_id") < F.col("b.det_id")) & overlaps_above("a", "b", iou)
    return a.join(b, [*GROUP, *CELL]).where(rule).select(*GROUP, *_pair_row("a", "b"))


def nms(
    boxes: DataFrame, conf: float = 0.15, iou: float = 0.9, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Non-maximum suppression per image and class.

    In the order of falling score, then `det_id`, a box is kept unless its overlap ratio
    with a box kept before exceeds `iou`.
    """
    _check_iou(iou)
    scored = boxes.where(confident(conf)).select(*BOX)
    if iou == 1:
        return scored
    hot = hot_keys(scored, GROUP, fold_limit)
    if hot is None:
        return _nms_by_fold(scored, iou)
    few, many = (joined(scored, hot, GROUP, how) for how in ("left_anti", "left_semi"))
    return _nms_by_fold(few, iou).unionByName(_nms_by_rounds(many, iou, fold_limit))


def _nms_by_fold(boxes: DataFrame, iou: float) -> DataFrame:
    """Groups of bounded size: one pass over the sorted array of a group."""
    fields = ["det_id", "x0", "y0", "x1", "y1", "score"]
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_rank"), *fields)))
    groups = boxes.groupBy(*GROUP).agg(ranked.alias("boxes"))

    def step(kept: Column, box: Column) -> Column:
        hit = F.exists(kept, lambda k: overlaps_above(k, box, iou))
        return F.when(hit, kept).otherwise(F.array_append(kept, box))

    none = F.filter("boxes", lambda _: F.lit(False))
    kept = groups.select(*GROUP, F.explode(F.aggregate("boxes", none, step)).alias("b"))
    return kept.select(*GROUP, *[F.col(f"b.{c}").alias(c) for c in fields]).select(*BOX)


@tidy
def _nms_by_rounds(boxes: DataFrame, iou: float, fold_limit: int) -> DataFrame:
    """Groups of any size: the same result in rounds.

    Each round settles the best `fold_limit` open boxes of every group by a fold. Nothing
    better is open, so the fold is exact for them. While groups are much larger than
    that, leaders of grid cells are settled as well, all over the image at once. Then
    every partner of a settled box is dropped.
    """
    kept = [boxes.where(~has_area())]  # an empty box neither drops nor is dropped
    open_boxes = written(boxes.where(has_area()).select(*BOX))
    partners = _Grid(iou, 1 - iou)
    best_first = Window.partitionBy(*GROUP).orderBy(F.col("score").desc(), "det_id")
    while True:
        sizes = open_boxes.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.agg(F.max("n")).first()[0]
        if largest is None:
            return reduce(DataFrame.unionByName, kept)
        top = open_boxes.withColumn("_rank", F.row_number().over(best_first))
        settled = _nms_by_fold(top.where(F.col("_rank") <= fold_limit).drop("_rank"), iou)
        if largest > ROUND_FOLDS * fold_limit:
            settled = settled.unionByName(_free_leaders(open_boxes, partners))
            settled = settled.dropDuplicates([*GROUP, "det_id"])
        settled = written(settled)
        kept.append(settled)
        rest = _packed(partners.home(open_boxes), "a", CELL).alias("m")
        gone = _packed(partners.probe(settled), "b", CELL).alias("o")
        rule = _same("m", "o", [*GROUP, *CELL]) & overlaps_above("a", "b", iou)
        # a settled box overlaps itself fully, so it leaves the open boxes here as well
        open_boxes = written(rest.join(gone, rule, "left_anti").select(*GROUP, "a.*").select(*BOX))


def _free_leaders(open_boxes: DataFrame, grid: _Grid) -> DataFrame:
    """Open boxes that are certainly kept, found all over an image at once.

    The best open box of a cell is free when it is better than the best one of every cell
    that can hold a partner of it. However many boxes a cell holds, they combine map-side
    into one leader.
    """
    order = F.struct((-F.col("score")).alias("rank"), "det_id", "score", "x0", "y0", "x1", "y1")
    cells = grid.home(open_boxes).groupBy(*GROUP, *CELL).agg(F.min(order).alias("b"))
    leads = written(cells.select(*GROUP, *CELL, "b"))
    flat = leads.select(*GROUP, *[F.col(f"b.{c}").alias(c) for c in BOX[2:]])
    seeking = grid.probe(flat).select(
        *GROUP, *CELL, "det_id", F.struct((-F.col("score")).alias("rank"), "det_id").alias("a")
    )
    blocked = (
        joined(seeking, leads, [*GROUP, *CELL])
        .where(F.struct("b.rank", "b.det_id") < F.col("a"))
        .select(*GROUP, "det_id")
        .distinct()
    )
    return joined(flat, blocked, [*GROUP, "det_id"], "left_anti").select(*BOX)


PARTNER_BLOCK = 2_048
"""Boxes of a cell that are compared with as many others at once."""


def _ratios(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Overlap and union of each box of `a` with each of `b`."""
    one, two = ({c: df[c].to_numpy(np.float64) for c in BOX[4:]} for df in (a, b))
    side = lambda low, high: np.maximum(
        np.minimum(one[high][:, None], two[high]) - np.maximum(one[low][:, None], two[low]), 0.0
    )
    both = side("x0", "x1") * side("y0", "y1")
    area = [(x["x1"] - x["x0"]) * (x["y1"] - x["y0"]) for x in (one, two)]
    return both, area[0][:, None] + area[1] - both


def _partners(a: pd.DataFrame, b: pd.DataFrame, iou: float) -> pd.DataFrame:
    """Per box of `a`: how many boxes of `b` are partners, and the best of them."""
    both, union_ = _ratios(a, b)
    hit = (both > iou * union_) & (a["det_id"].to_numpy()[:, None] != b["det_id"].to_numpy())
    ratio = np.where(hit, both / np.where(union_ > 0, union_, 1), -1.0)
    copies = b["copies"].to_numpy()
    out = a[[*GROUP, "det_id"]].assign(partners=(hit * copies).sum(axis=1), best_iou=ratio.max(axis=1))
    names = b["det_id"].to_numpy(np.int64)
    tied = np.where(ratio == ratio.max(axis=1)[:, None], names, np.iinfo(np.int64).max)
    return out.assign(best=tied.min(axis=1))[lambda rows: rows["partners"] > 0]


@tidy
def partner_counts(boxes: DataFrame, iou: float, block: int = PARTNER_BLOCK, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """One row per box with area: partners, best_id, best_iou.

    A partner is another box of the same image and class whose overlap ratio exceeds `iou`;
    the best one has the highest ratio, ties go to the lower det_id. A box without a partner
    has 0 and nulls. Exact copies are merged first. Groups of a bounded size are compared
    pair by pair. In larger ones only counts leave a task: boxes of a grid cell are cut into
    blocks, the blocks of neighbouring cells are compared, and each comparison returns a row
    per box.
    """
    _check_iou(iou)
    shape = [*GROUP, *BOX[4:]]
    solid = boxes.where(has_area())
    shapes = written(solid.groupBy(*shape).agg(F.min("det_id").alias("det_id"), F.count(F.lit(1)).alias("copies")))
    hot = hot_keys(shapes, GROUP, pair_limit)
    if hot is None:
        found = _partners_by_group(shapes, iou)
    else:
        few, many = (joined(shapes, hot, GROUP, how) for how in ("left_anti", "left_semi"))
        found = _partners_by_cell(many, iou, block).unionByName(_partners_by_group(few, iou))
    best = F.max(F.struct("best_iou", (-F.col("best")).alias("_best")))
    summed = found.groupBy(*GROUP, "det_id").agg(F.sum("partners").alias("_found"), best.alias("_top"))
    told = joined(shapes, written(summed), [*GROUP, "det_id"], "left")
    alike = F.lit(iou < 1) & (F.col("copies") > 1)
    told = told.select(
        *shape, F.col("det_id").alias("_first"), alike.alias("_alike"), F.col("_top"),
        (F.coalesce("_found", F.lit(0)) + F.when(alike, F.col("copies") - 1).otherwise(0)).alias("partners"),
    )
    own = joined(solid.select(*shape, "det_id"), written(told), shape)
    return joined(own, _second(solid, shape), shape, "left").select(
        *GROUP, "det_id", "partners",
        F.when(F.col("_alike"), F.when(F.col("det_id") == F.col("_first"), F.col("_next")).otherwise(F.col("_first")))
        .otherwise(-F.col("_top._best")).cast(shapes.schema["det_id"].dataType).alias("best_id"),
        F.when(F.col("_alike"), F.lit(1.0)).otherwise(F.col("_top.best_iou")).alias("best_iou"),
    )


def _partners_by_group(shapes: DataFrame, iou: float) -> DataFrame:
    both = _packed(shapes, "a", []).alias("l").join(_packed(shapes, "b", []).alias("r"), same_keys("l", "r", GROUP))
    hit = both.where((F.col("a.det_id") != F.col("b.det_id")) & overlaps_above("a", "b", iou)).select(
        *[F.col(f"l.{c}") for c in GROUP], F.col("a.det_id").alias("det_id"), F.col("b.copies").alias("partners"),
        (intersection("a", "b").cast("double") / union("a", "b")).alias("best_iou"), F.col("b.det_id").cast("long").alias("best"),
    )
    best = F.max(F.struct("best_iou", (-F.col("best")).alias("_best")))
    told = hit.groupBy(*GROUP, "det_id").agg(F.sum("partners").alias("partners"), best.alias("_top"))
    return told.select(*GROUP, "det_id", "partners", F.col("_top.best_iou").alias("best_iou"), (-F.col("_top._best")).alias("best"))


def _partners_by_cell(shapes: DataFrame, iou: float, block: int) -> DataFrame:
    grid = _Grid(iou, 1.0 - iou)
    homes = grid.home(shapes)
    many = homes.groupBy(*GROUP, *CELL).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    many = written(many)
    chance = F.xxhash64("det_id")
    stored = joined(homes, many, [*GROUP, *CELL]).withColumn("_theirs", F.pmod(chance, F.col("_blocks")).cast("int"))
    probes = joined(grid.probe(shapes), many, [*GROUP, *CELL])
    # a cell is probed by its neighbours as well, so its probes are cut on their own
    asked = written(probes)
    askers = asked.groupBy(*GROUP, *CELL).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_askers"))
    askers = written(askers)
    met = [*GROUP, *CELL, "_own", "_theirs"]
    asked = joined(asked, askers, [*GROUP, *CELL]).withColumn("_own", F.pmod(chance, F.col("_askers")).cast("int"))
    asked = asked.withColumn("_theirs", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    stored = joined(stored, askers, [*GROUP, *CELL]).withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("_askers") - 1)))
    keys = {f.name: f.dataType.simpleString() for f in shapes.schema}
    schema = ", ".join(f"{c} {keys[c]}" for c in [*GROUP, "det_id"]) + ", partners long, best_iou double, best long"

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in [*GROUP, "det_id", "partners", "best_iou", "best"]})
        return _partners(a, b, iou)

    found = written(asked).groupBy(*met).cogroup(written(stored).groupBy(*met)).applyInPandas(compare, schema)
    return found


def _second(boxes: DataFrame, shape: list[str]) -> DataFrame:
    """The second lowest det_id of each shape that occurs more than once."""
    least = boxes.groupBy(*shape).agg(F.min("det_id").alias("_least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rest = joined(boxes, written(least.drop("n")), shape).where("det_id > _least")
    return written(rest.groupBy(*shape).agg(F.min("det_id").alias("_next")))
