"""Detections as rows: filters, lookups and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.geometry import has_area, int_corners, round_score
from veilframe.operators.selection import on_list
from veilframe.plans.scale import HOT_ROWS, numbered, small


def confident(conf: float = 0.15) -> Column:
    """Score at or above the threshold; NaN, which sorts above all numbers, is dropped."""
    return (F.col("score") >= F.lit(float(conf))) & ~F.isnan("score")


def name_classes(boxes: DataFrame, classes: DataFrame, strict: bool = False) -> DataFrame:
    """Add the class name by id.

    Boxes of an unknown class are dropped, or fail the job when strict.
    """
    names = small(classes.select("class_id", "class_name"))
    if not strict:
        return boxes.join(names, "class_id")
    message = F.concat(F.lit("unknown class id "), F.col("class_id").cast("string"))
    checked = F.coalesce(F.col("class_name"), F.raise_error(message).cast("string"))
    return boxes.join(names, "class_id", "left").withColumn("class_name", checked)


def classes_from_list(entries: DataFrame, names: str) -> DataFrame:
    """A class dictionary from a column of name arrays; the place is the id."""
    return entries.select(F.posexplode(names).alias("class_id", "class_name"))


def class_ids(classes: DataFrame) -> DataFrame:
    """The inverted dictionary; of equal names the last id wins."""
    return classes.groupBy("class_name").agg(F.max("class_id").alias("class_id"))


def valid_boxes(boxes: DataFrame, strict: bool = False) -> DataFrame:
    """Boxes that hold a pixel after truncation; an empty one fails the job when strict."""
    cut = boxes.withColumns({c: F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")})
    if not strict:
        return cut.where(has_area())
    message = F.concat_ws(" ", F.lit("empty box on image"), F.col("image_id").cast("string"))
    return cut.where(F.when(has_area(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def rejected_boxes(boxes: DataFrame) -> DataFrame:
    """The boxes that `valid_boxes` leaves out."""
    cut = boxes.withColumns({c: F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")})
    return cut.where(~has_area())


def detection_rows(boxes: DataFrame) -> DataFrame:
    """The published detection record: nine named columns."""
    return boxes.select(
        F.col("image_path"),
        F.element_at(F.split("image_path", "/"), -1).alias("base_image"),
        F.col("class_id").cast("int").alias("class_id"),
        F.col("class_name"),
        *int_corners(),
        round_score("score").alias("score"),
    )


def number_boxes(
    boxes: DataFrame, order: Sequence[Column | str], name: str = "det_id", start: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the boxes of each image in a total order."""
    return numbered(boxes, ["image_id"], order, name, start=start, hot_rows=hot_rows)


def images_with_boxes(images: DataFrame, boxes: DataFrame, keep_empty: bool) -> DataFrame:
    """Images with their boxes, one row per box; `keep_empty` keeps images without any.

    Boxes are the side that can be skewed, and an outer join may not split its
    null-supplied side. So the matches are an inner join, where a hot image splits, and
    the images without boxes come from an anti join against distinct ids.
    """
    matched = boxes.join(images, "image_id")
    if not keep_empty:
        return matched
    empty = images.join(boxes.select("image_id").distinct(), "image_id", "left_anti")
    return matched.unionByName(empty, allowMissingColumns=True)


def blurred_per_image(
    images: DataFrame, boxes: DataFrame, classes: DataFrame, blur_classes: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Count the boxes on the blur list per image, 0 when there are none.

    Boxes are counted per image and class before any join, so a hot image arrives as a
    few rows.
    """
    counts = boxes.groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("_n"))
    listed = name_classes(counts, classes, strict).where(on_list("class_name", blur_classes))
    blurred = listed.groupBy("image_id").agg(F.sum("_n").cast("int").alias("blurred_objects"))
    return images.join(blurred, "image_id", "left").withColumn(
        "blurred_objects", F.coalesce("blurred_objects", F.lit(0))
    )


def box_counts(boxes: DataFrame, kept: Column) -> DataFrame:
    """How many boxes, how many are kept, and how many classes occur."""
    by_class = boxes.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("boxes"), F.count_if(kept).alias("kept")
    )
    return by_class.agg(
        F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"),
        F.count("class_id").alias("classes"),
    )


def distinct_images(boxes: DataFrame) -> DataFrame:
    """Images that have at least one box."""
    return boxes.select("image_path").distinct()
