"""Schemas and options shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import types as T

OBJECT_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("blurred", T.BooleanType()),
        T.StructField("blurred_objects", T.IntegerType()),
    ]
)

DETECTION_SCHEMA = T.StructType(
    [
        T.StructField("image_path", T.StringType()),
        T.StructField("base_image", T.StringType()),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("x0", T.IntegerType()),
        T.StructField("y0", T.IntegerType()),
        T.StructField("x1", T.IntegerType()),
        T.StructField("y1", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)

RASTER_SCHEMA = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("pixels", T.ArrayType(T.IntegerType())),
    ]
)

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("frame_idx", T.IntegerType()),
        T.StructField("frame_name", T.StringType()),
    ]
)

CLASS_SCHEMA = T.StructType(
    [
        T.StructField("class_id", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Options:
    """Settings of a redaction run; the defaults are the documented ones."""

    blur_classes: tuple[str, ...]
    min_altitude: float
    kernel: int
    draw_classes: tuple[str, ...] = ()
    conf: float = 0.15
    iou: float = 0.9
    lookback: timedelta = field(default=timedelta(hours=24))
    exclude: str = "00_UNSORTED"
    min_bytes: int = 1024
    strict: bool = False
    n_frames: int | None = 100
    fps: int = 24
    log_table: str | None = None

    def __post_init__(self) -> None:
        if isinstance(self.kernel, bool) or not isinstance(self.kernel, int) or self.kernel < 1:
            raise ValueError(f"kernel must be an integer of at least 1, got {self.kernel!r}")
        if not 0 < self.iou <= 1:
            raise ValueError(f"iou must lie in (0, 1], got {self.iou!r}")
