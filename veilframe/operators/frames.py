"""Frames of videos: numbering, order, size and assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.labels import frame_seconds
from veilframe.functions.paths import base_name, dir_by_replace, join_path, stem_number
from veilframe.plans.scale import HOT_ROWS, numbered, positioned

PUSHED = 1_000
"""Largest rank that Spark limits before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold)."""


def number_frames(
    frames: DataFrame, order: Sequence[Column | str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Number the frames of each video from 0."""
    return numbered(frames, ["video_id"], order, "frame_idx", hot_rows=hot_rows)


def order_frames(frames: DataFrame, strict: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Place of each frame in its video by the number in its name.

    Equal numbers (`1.jpg`, `1.png`) fall back to the name.
    """
    keyed = frames.withColumn("stem", stem_number("frame_name", strict))
    return numbered(keyed, ["video_id"], ["stem", "frame_name"], "place", hot_rows=hot_rows)


def first_frames(frames: DataFrame, n: int | None = 100, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first frames of each video by number, or all of them for None.

    Up to `PUSHED` the rank filter is applied before the shuffle too, so a hot video sends at
    most `n` rows per task. With a larger `n` frames are numbered, which splits a hot video.
    """
    if n is None:
        return frames
    if n > PUSHED:
        keyed = frames.withColumn("_stem", stem_number("frame_name"))
        placed = numbered(keyed, ["video_id"], ["_stem", "frame_name"], "_place", hot_rows=hot_rows)
        return placed.where(F.col("_place") < F.lit(n)).drop("_stem", "_place")
    rank = F.row_number().over(
        Window.partitionBy("video_id").orderBy(stem_number("frame_name"), "frame_name")
    )
    return frames.withColumn("_rank", rank).where(F.col("_rank") <= F.lit(n)).drop("_rank")


def first_frames_of_one(frames: DataFrame, n: int | None = 100) -> DataFrame:
    """The same for a single video, as a plain ordered limit."""
    if n is None:
        return frames
    return frames.orderBy(stem_number("frame_name"), "frame_name").limit(n)


def order_paths(rows: DataFrame, tie: Sequence[Column | str], path: str = "image_path") -> DataFrame:
    """Place of each row in the text order of its path.

    The order is global, so it is found by range partitions; `tie` makes it total.
    """
    return positioned(rows, [path, *tie], "place")


def sample_frame(frames: DataFrame) -> DataFrame:
    """One frame per video, always the same: the one with the lowest number."""
    key = F.struct(stem_number("frame_name"), F.col("frame_name"))
    return frames.groupBy("video_id").agg(F.min_by("frame_name", key).alias("frame_name"))


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"))


def first_frame_size(frames: DataFrame, order: Sequence[str] = ("frame_idx",)) -> DataFrame:
    """Size of a video: that of its first frame."""
    size = F.min_by(F.struct("width", "height"), F.struct(*order))
    return (
        frames.groupBy("video_id")
        .agg(size.alias("size"))
        .select("video_id", F.col("size.width").alias("width"), F.col("size.height").alias("height"))
    )


def manifest(
    frames: DataFrame, videos: DataFrame, output_root: str, fps: int = 24, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Everything a video writer needs, one row per frame in playing order.

    `frames` has the size of each frame, `videos` the path of each video.
    """
    placed = order_frames(frames, hot_rows=hot_rows)
    keyed = frames.withColumn("stem", stem_number("frame_name"))
    size = first_frame_size(keyed, ("stem", "frame_name"))
    target = join_path(
        join_path(F.lit(output_root), dir_by_replace("video_path")), base_name("video_path")
    )
    heads = size.join(videos, "video_id").select(
        "video_id",
        F.col("width").alias("video_width"),
        F.col("height").alias("video_height"),
        target.alias("output_path"),
    )
    fits = (F.col("width") == F.col("video_width")) & (F.col("height") == F.col("video_height"))
    return placed.join(heads, "video_id").select(
        "video_id",
        "output_path",
        "place",
        "frame_name",
        "video_width",
        "video_height",
        fits.alias("fits"),
        frame_seconds("place", fps).alias("seconds"),
    )
