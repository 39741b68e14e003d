"""Whole runs: the incremental image job and the video job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.model import Options
from veilframe.operators.detections import (
    blurred_per_image,
    confident,
    name_classes,
    valid_boxes,
)
from veilframe.operators.frames import first_frames, manifest
from veilframe.operators.overlap import nms
from veilframe.operators.runlog import log_rows, quarantined, run_summary
from veilframe.operators.selection import (
    candidates,
    classify,
    on_list,
    route,
    split_routes,
    with_altitude,
)
from veilframe.operators.raster import clip_boxes, image_sizes
from veilframe.operators.waves import redact
from veilframe.plans.scale import restricted, written
from veilframe.sources.sinks import add_once, published


@dataclass(frozen=True)
class Work:
    """The objects of a run, sorted by what happens to them."""

    candidates: DataFrame
    bad: DataFrame
    redact: DataFrame
    passed: DataFrame


def choose_work(objects: DataFrame, log: DataFrame, as_of: Column, options: Options) -> Work:
    """Select candidates, set bad ones aside, and route the rest by altitude."""
    return sorted_out(candidates(objects, log, as_of, options.lookback, options.exclude), options)


def sorted_out(chosen: DataFrame, options: Options) -> Work:
    """Set bad candidates aside and route the rest by altitude."""
    checked = classify(chosen, options.min_bytes, signature="content" in chosen.columns)
    usable = with_altitude(checked.where(F.col("valid"))).drop("reason", "valid")
    below, above = split_routes(route(usable, options.min_altitude))
    return Work(chosen, quarantined(checked), below, above)


def settled(work: Work) -> Work:
    """The same work, written: a store or log that changes during the run does not change it."""
    return Work(*(written(getattr(work, f.name)) for f in fields(work)))


def settled_work(objects: DataFrame, log: DataFrame, as_of: Column, options: Options) -> Work:
    """The objects of a run, settled; store and log are read once, for the candidates."""
    chosen = written(candidates(objects, log, as_of, options.lookback, options.exclude))
    work = sorted_out(chosen, options)
    return Work(chosen, written(work.bad), written(work.redact), written(work.passed))


def kept_detections(below: DataFrame, detections: DataFrame, options: Options, suppress: bool) -> DataFrame:
    """Confident detections of the images of a run; other images are left out first.

    `suppress` removes overlapping boxes, for detectors that do not.
    """
    wanted = restricted(detections, below.select("image_id"), "image_id")
    return nms(wanted, options.conf, options.iou) if suppress else wanted.where(confident(options.conf))


def counted_log(work: Work, boxes: DataFrame, stamp: Column) -> DataFrame:
    """Log rows of a run from its applied boxes: the blurred ones are counted per image."""
    blurred = boxes.where("blur").groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    counts = work.redact.select("image_id", "file_name").join(blurred, "image_id", "left")
    return log_rows(counts.withColumn("blurred_objects", F.coalesce("_n", F.lit(0))), work.passed, stamp)


def image_log(
    work: Work, detections: DataFrame, classes: DataFrame, stamp: Column, options: Options,
    suppress: bool = True,
) -> DataFrame:
    """Log rows of a run without rasters: the kept detections on the blur list are counted.

    `image_run` logs the boxes that it applies, which leaves out those without a pixel.
    """
    below = work.redact.select("image_id", "file_name")
    kept = kept_detections(below, detections, options, suppress)
    return log_rows(blurred_per_image(below, kept, classes, options.blur_classes, options.strict), work.passed, stamp)


def boxes_to_redact(boxes: DataFrame, options: Options) -> DataFrame:
    """Whole-pixel boxes with what to do: outline, blur or both.

    With a draw list only its classes count, and the blur list applies among them.
    """
    solid = valid_boxes(boxes, options.strict)
    blur = on_list("class_name", options.blur_classes)
    if options.draw_classes:
        solid = solid.where(on_list("class_name", options.draw_classes))
    return solid.select(
        "image_id", "det_id", "x0", "y0", "x1", "y1",
        F.lit(bool(options.draw_classes)).alias("draw"), blur.alias("blur"),
    )


def image_run(
    objects: DataFrame,
    log: DataFrame,
    scan: DataFrame,
    detect: Callable[[DataFrame], DataFrame],
    classes: DataFrame,
    as_of: Column,
    options: Options,
    suppress: bool = True,
) -> dict[str, DataFrame]:
    """One incremental run over images: names, redacted scanlines, log, summary, bad objects.

    `detect` maps scanlines to raw boxes. It sees only images below the altitude gate, and
    its result is written, so that no image is scored twice.
    """
    work = settled_work(objects, log, as_of, options)
    # written, as sizes, the detector and the redaction all read the lines of the run
    lines = written(restricted(scan, work.redact.select("image_id"), "image_id"))
    raw = written(detect(lines))
    kept = kept_detections(work.redact, raw, options, suppress)
    found = boxes_to_redact(name_classes(kept, classes, options.strict), options)
    boxes = written(clip_boxes(found, image_sizes(lines)))
    rows = written(counted_log(work, boxes, as_of))
    return {
        "images": work.redact.select("image_id", "file_name"),
        "redacted": redact(lines, boxes, options.kernel, clipped=True),
        "log": rows,
        "summary": run_summary(work.candidates, rows),
        "bad": work.bad,
    }


def video_run(
    frames: DataFrame,
    videos: DataFrame,
    scan: DataFrame,
    detect: Callable[[DataFrame], DataFrame],
    classes: DataFrame,
    output_root: str,
    options: Options,
    only_with_boxes: bool = False,
) -> dict[str, DataFrame]:
    """Redact the frames of all videos and list how to assemble them.

    `frames` has `video_id, frame_name, image_id, width, height`. Frames beyond the
    wanted number are left out before scoring. With `only_with_boxes` frames without a
    kept box vanish from the output; otherwise every frame is written.
    """
    wanted = written(first_frames(frames, options.n_frames))
    lines = restricted(scan, wanted.select("image_id"), "image_id")
    raw = written(detect(lines).where(confident(options.conf)))
    named = name_classes(raw, classes, options.strict)
    boxes = boxes_to_redact(named, options)
    if only_with_boxes:
        hit = boxes.select("image_id").distinct()
        wanted = wanted.join(hit, "image_id", "left_semi")
        lines = restricted(lines, hit, "image_id")
    return {
        "detections": named,
        "redacted": redact(lines, boxes, options.kernel),
        "manifest": manifest(wanted, videos, output_root, options.fps),
    }


def publish_videos(manifest_rows: DataFrame, path: str) -> int:
    """Publish the manifests of videos that are not published yet, each as a whole; how many.

    A video is known by its output path. One that is there already stays as it is.
    """
    spark = manifest_rows.sparkSession
    known = published(spark, path)
    fresh = manifest_rows if known is None else manifest_rows.join(known, "output_path", "left_anti")
    fresh = written(fresh)
    count = fresh.select("output_path").distinct().count()
    if count:
        add_once(fresh, path, "output_path")
    return count
