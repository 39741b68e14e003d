"""From scanlines to boxes: fit images to the model's canvas, score them, move the boxes back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.geometry import half_even, letterbox, round_score, unletterbox
from veilframe.operators.raster import image_sizes, pad, resample, swap_channels, to_tensor
from veilframe.operators.scoring import score


def geometry(scan: DataFrame, width: int, height: int) -> DataFrame:
    """image_id and how its image is fitted into a canvas; see `letterbox`."""
    fit = letterbox("width", "height", width, height, auto=False).alias("_fit")
    return image_sizes(scan).select("image_id", fit).select("image_id", "_fit.*")


def preprocess(scan: DataFrame, width: int, height: int, fill: int = 0, swap: bool = True) -> DataFrame:
    """One model input per image: resampled, padded to the canvas, channels swapped, scaled to 0..1."""
    fits = geometry(scan, width, height)
    sizes = fits.select("image_id", F.col("inner_width").alias("new_width"), F.col("inner_height").alias("new_height"))
    inner = resample(scan, sizes)
    # the borders follow from the size that an image has now, so no second join is needed
    across, down = ((F.lit(float(n)) - F.col(c).cast("double")) / 2.0 for n, c in ((width, "width"), (height, "height")))
    borders = [half_even(half + F.lit(nudge)).cast("int") for half in (down, across) for nudge in (-0.1, 0.1)]
    canvas = pad(inner, *borders, fill=fill)
    return to_tensor(swap_channels(canvas) if swap else canvas, most=3 * width * height)


def postprocess(found: DataFrame, fits: DataFrame) -> DataFrame:
    """Raw boxes in whole pixels of their images, with scores of two places."""
    placed = found.join(fits.select("image_id", "ratio", "dw", "dh"), "image_id")
    corners = unletterbox(F.col("ratio"), F.col("dw"), F.col("dh"))
    return placed.select("image_id", "det_id", "class_id", round_score("score").alias("score"), *corners)


def detector(
    make_predict_fn: Callable, width: int = 960, height: int = 960, channels: int = 3, batch_size: int = 8,
    swap: bool = True,
) -> Callable[[DataFrame], DataFrame]:
    """A `detect` step for `image_run` and `video_run` around a model; see `scoring.score`.

    The model sees batches of `channels` x `height` x `width`, and its boxes are in that canvas.
    """

    def detect(lines: DataFrame) -> DataFrame:
        tensors = preprocess(lines, width, height, swap=swap)
        found = score(tensors, make_predict_fn, [channels, height, width], batch_size=batch_size)
        return postprocess(found, geometry(lines, width, height))

    return detect
