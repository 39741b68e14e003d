"""Ordered redaction of overlapping boxes.

Boxes are applied in `det_id` order, each on the result of the ones before. A blur reads
and writes only the pixels of its own box, so boxes that share no pixel may go at the
same time. A box's wave is one more than the highest wave among earlier boxes that it
touches; waves run one after another, the boxes of a wave together.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.geometry import has_area, touches
from veilframe.operators.raster import (
    box_blur,
    clip_boxes,
    image_sizes,
    outlined_lines,
)
from veilframe.operators.whole import divided, painted_whole
from veilframe.plans.scale import (
    FOLD_LIMIT,
    hot_keys,
    joined,
    numbered,
    restricted,
    tidy,
    written,
)

SHAPE = ["det_id", "x0", "y0", "x1", "y1"]


def blur_waves(boxes: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Add `wave` to boxes with whole-pixel corners; empty boxes are left out."""
    solid = boxes.where(has_area())
    hot = hot_keys(solid, ["image_id"], fold_limit)
    if hot is None:
        return _waves_by_fold(solid)
    few, many = (joined(solid, hot, ["image_id"], how) for how in ("left_anti", "left_semi"))
    return _waves_by_fold(few).unionByName(_waves_by_strips(many, fold_limit))


def _waves_by_fold(boxes: DataFrame) -> DataFrame:
    """Images with a bounded number of boxes: one pass over the ordered array.

    A column `_least` has the wave that a box has at least, if earlier boxes are not here.
    """
    columns = [c for c in boxes.columns if c != "_least"]
    if "_least" not in boxes.columns:
        boxes = boxes.withColumn("_least", F.lit(0))
    rest = [c for c in columns if c not in ("image_id", "det_id")]
    box = F.struct("det_id", *rest, F.col("_least").alias("wave"))
    images = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(box)).alias("boxes"))

    def step(done: Column, box: Column) -> Column:
        before = F.transform(F.filter(done, lambda d: touches(d, box)), lambda d: d["wave"])
        wave = F.greatest(F.coalesce(F.array_max(before) + F.lit(1), F.lit(0)), box["wave"])
        return F.array_append(done, box.withField("wave", wave))

    none = F.filter("boxes", lambda _: F.lit(False))
    waves = images.select("image_id", F.explode(F.aggregate("boxes", none, step)).alias("b"))
    return waves.select(*[f"b.{c}" if c != "image_id" else c for c in columns], "b.wave")


SURFACE = ["edges", "waves"]
"""Of a strip: where its stretches start, the last one ending, and the highest wave in each."""


def _in_strips(boxes: DataFrame) -> DataFrame:
    """Add `strips`, the numbers (from, to) of the strips of its image that a box covers.

    The upper and lower edges of all boxes of an image cut it into strips, so a box covers
    a strip wholly or not at all, however many lines that is.
    """
    edges = boxes.selectExpr("image_id", "explode(array(y0, y1)) as y").distinct()
    ranked = written(numbered(edges, ["image_id"], ["y"], "_strip"))
    first = ranked.select("image_id", F.col("y").alias("y0"), F.col("_strip").alias("_first"))
    after = ranked.select("image_id", F.col("y").alias("y1"), F.col("_strip").alias("_after"))
    return joined(joined(boxes, first, ["image_id", "y0"]), after, ["image_id", "y1"])


def _highest(key: tuple, boxes: pd.DataFrame, surface: pd.DataFrame) -> pd.DataFrame:
    """For each box of a strip, one more than the highest wave below it."""
    if not len(surface):
        return boxes.assign(least=0)[["image_id", "det_id", "least"]]
    edges, waves = (np.asarray(surface[c].iat[0]) for c in SURFACE)
    first = np.searchsorted(edges, boxes["x0"].to_numpy(), "right") - 1
    after = np.searchsorted(edges, boxes["x1"].to_numpy(), "left")
    least = [waves[max(a, 0) : b].max(initial=-1) + 1 for a, b in zip(first, after, strict=True)]
    return boxes.assign(least=least)[["image_id", "det_id", "least"]]


def _raised(key: tuple, boxes: pd.DataFrame, surface: pd.DataFrame) -> pd.DataFrame:
    """The surface of a strip after more boxes: the highest wave at each place."""
    if not len(boxes):
        return surface
    x0, x1, wave = (boxes[c].to_numpy() for c in ("x0", "x1", "wave"))
    edges, waves = (np.asarray(surface[c].iat[0]) for c in SURFACE) if len(surface) else (np.empty(0, int), np.empty(0, int))
    places = np.unique(np.concatenate([edges, x0, x1]))
    out = np.full(len(places) - 1, -1)
    if len(edges):
        at = np.searchsorted(edges, places[:-1], "right") - 1
        known = (at >= 0) & (at < len(waves))
        out[known] = waves[at[known]]
    for a, b, w in zip(np.searchsorted(places, x0), np.searchsorted(places, x1), wave, strict=True):
        np.maximum(out[a:b], w, out=out[a:b])
    keep = np.concatenate([[True], out[1:] != out[:-1]])  # equal neighbours are one stretch
    row = {"image_id": boxes["image_id"].iat[0], "strip": boxes["strip"].iat[0]}
    return pd.DataFrame([{**row, "edges": np.append(places[:-1][keep], places[-1]), "waves": out[keep]}])


@tidy
def _waves_by_strips(boxes: DataFrame, block: int) -> DataFrame:
    """Images with any number of boxes: `block` of each image at a time, in order.

    A round finds for each of its boxes the highest wave of earlier boxes below it, from the
    surface of the strips that it covers, settles the round by a fold, and raises the
    surface. Nothing is as large as the area of the boxes: a strip has a bounded number of
    boxes in a round, and as many stretches as there are edges across it.
    """
    placed = _in_strips(numbered(boxes, ["image_id"], ["det_id"], "_n"))
    placed = written(placed.withColumn("_round", F.floor(F.col("_n") / block).cast("int")))
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    ids = f"image_id {kinds['image_id']}"
    surface = boxes.sparkSession.createDataFrame([], f"{ids}, strip int, edges array<long>, waves array<long>")
    strips = "explode(sequence(_first, _after - 1)) as strip"
    out, rounds = [], (placed.agg(F.max("_round")).first()[0] or 0) + 1
    for number in range(rounds):
        now = placed.where(F.col("_round") == number)
        if number:
            spread = now.selectExpr("image_id", "det_id", "x0", "x1", strips).groupBy("image_id", "strip")
            found = spread.cogroup(surface.groupBy("image_id", "strip"))
            found = found.applyInPandas(_highest, f"{ids}, det_id {kinds['det_id']}, least int")
            least = found.groupBy("image_id", "det_id").agg(F.max("least").alias("_least"))
            now = joined(now, least, ["image_id", "det_id"])
        settled = written(_waves_by_fold(now.select(*boxes.columns, *(["_least"] if number else []))))
        out.append(settled)
        if number + 1 < rounds:
            ended = joined(settled, placed.select("image_id", "det_id", "_first", "_after"), ["image_id", "det_id"])
            spread = ended.selectExpr("image_id", "x0", "x1", "wave", strips).groupBy("image_id", "strip")
            surface = written(spread.cogroup(surface.groupBy("image_id", "strip")).applyInPandas(_raised, surface.schema))
    return reduce(DataFrame.unionByName, out)


@tidy
def redact(
    scan: DataFrame, boxes: DataFrame, k: int, fold_limit: int = FOLD_LIMIT, clipped: bool = False
) -> DataFrame:
    """Apply all boxes to their images, in order.

    Optional boolean columns choose per box: `draw` adds an outline before the blur, and
    `blur` says whether to blur at all (by default every box is blurred, none is drawn).
    `clipped` says that no box reaches beyond its image, so that sizes need not be read.

    Images without a box pass straight through; while those with one are few enough to
    broadcast their ids, the others are not moved. Images that fit one task meet their boxes
    in it, after one shuffle. Larger ones, and those of many boxes, go wave by wave.
    """
    if "draw" not in boxes.columns:
        boxes = boxes.withColumn("draw", F.lit(False))
    if "blur" not in boxes.columns:
        boxes = boxes.withColumn("blur", F.lit(True))
    boxes = written(boxes.select("image_id", *SHAPE, "draw", "blur").where("draw or blur"))
    if boxes.isEmpty():
        return scan
    untouched, lines, own, large = divided(scan, boxes, fold_limit)
    done = untouched.unionByName(painted_whole(lines, own, k, clipped))
    if large is None:
        return done
    some, marked = (restricted(df, large, "image_id") for df in (scan, boxes))
    return done.unionByName(redacted_by_waves(some, marked, k, fold_limit, clipped))


def redacted_by_waves(scan: DataFrame, boxes: DataFrame, k: int, fold_limit: int, clipped: bool) -> DataFrame:
    """Apply boxes (`image_id`, shape, `draw`, `blur`) to images of any size, with any number of boxes.

    The lines are written once, with the last wave that covers them: lines that no box covers
    are done, the others go from wave to wave only as long as a later box covers them.
    """
    if not clipped:
        boxes = written(clip_boxes(boxes, image_sizes(scan)))
    boxes = written(blur_waves(boxes, fold_limit))
    top, any_draw, any_blur = boxes.agg(F.max("wave"), F.bool_or("draw"), F.bool_or("blur")).first()
    if top is None:
        return scan

    def apply(lines: DataFrame, now: DataFrame) -> DataFrame:
        if any_draw:
            lines = outlined_lines(lines, now.where("draw"))
        if any_blur:
            lines = box_blur(lines, now.where("blur"), k)
        return lines

    covered = boxes.selectExpr("image_id", "wave", "explode(sequence(y0, y1 - 1)) as y")
    last = written(covered.groupBy("image_id", "y").agg(F.max("wave").alias("_last")))
    tagged = written(scan.join(last, ["image_id", "y"], "left"))
    done = [tagged.where("_last is null").drop("_last")]
    active = tagged.where("_last is not null")
    for wave in range(top):
        after = written(apply(active, boxes.where(F.col("wave") == wave)))
        done.append(after.where(F.col("_last") == wave).drop("_last"))
        active = after.where(F.col("_last") > wave)
    done.append(apply(active, boxes.where(F.col("wave") == top)).drop("_last"))
    return reduce(DataFrame.unionByName, done)
