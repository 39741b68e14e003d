"""Label text and lookup expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_text(class_name: Column | str, score: Column | str) -> Column:
    """Annotation text: class and score."""
    name = F.col(class_name) if isinstance(class_name, str) else class_name
    value = F.col(score) if isinstance(score, str) else score
    return F.concat_ws(" ", name, value.cast("string"))


def label_anchor(x0: Column | str = "x0", y0: Column | str = "y0") -> Column:
    """Where the text goes: ten pixels above the upper left corner."""
    x = F.col(x0) if isinstance(x0, str) else x0
    y = F.col(y0) if isinstance(y0, str) else y0
    return F.struct(x.alias("x"), (y - F.lit(10)).alias("y"))


def lookup(mapping: Column, key: Any, default: Any) -> Column:
    """A map entry, or the default when the key is absent."""
    key = key if isinstance(key, Column) else F.lit(key)
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(mapping, key), default)


def frame_seconds(frame_idx: Column | str, fps: int = 24) -> Column:
    """Playback time of a frame at a fixed rate."""
    idx = F.col(frame_idx) if isinstance(frame_idx, str) else frame_idx
    return idx / F.lit(float(fps))
