"""Box and image-size arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x0", "y0", "x1", "y1")


def col(prefix: str | Column, name: str) -> Column:
    """A field of a struct column, or a column whose alias carries the prefix."""
    return F.col(f"{prefix}.{name}") if isinstance(prefix, str) else prefix[name]


def int_corners() -> list[Column]:
    """Corners truncated toward zero."""
    return [F.col(c).cast("int").alias(c) for c in CORNERS]


def area(b: str | Column) -> Column:
    return (col(b, "x1") - col(b, "x0")) * (col(b, "y1") - col(b, "y0"))


def intersection(a: str | Column, b: str | Column) -> Column:
    """Overlap area of two boxes, 0 when apart."""
    zero = F.lit(0)
    width = F.least(col(a, "x1"), col(b, "x1")) - F.greatest(col(a, "x0"), col(b, "x0"))
    height = F.least(col(a, "y1"), col(b, "y1")) - F.greatest(col(a, "y0"), col(b, "y0"))
    return F.greatest(width, zero) * F.greatest(height, zero)


def union(a: str | Column, b: str | Column) -> Column:
    return area(a) + area(b) - intersection(a, b)


def overlaps_above(a: str | Column, b: str | Column, iou: float) -> Column:
    """True when the overlap ratio exceeds `iou`, without dividing."""
    return intersection(a, b) > F.lit(float(iou)) * union(a, b)


def touches(a: str | Column, b: str | Column) -> Column:
    """True when two half-open boxes share a pixel."""
    return (
        (col(a, "x0") < col(b, "x1"))
        & (col(b, "x0") < col(a, "x1"))
        & (col(a, "y0") < col(b, "y1"))
        & (col(b, "y0") < col(a, "y1"))
    )


def has_area(b: str | None = None) -> Column:
    """True for a box that holds at least one pixel."""
    name = (lambda c: f"{b}.{c}") if b else (lambda c: c)
    return (F.col(name("x1")) > F.col(name("x0"))) & (F.col(name("y1")) > F.col(name("y0")))


def half_even(x: Column) -> Column:
    """Round to the nearest whole number, ties to even."""
    return F.rint(x)


def round_score(x: Column | str) -> Column:
    """Round to two places by the exact binary value, ties to even.

    The product by 100 is rounded itself, so a value that looks like a tie need not be
    one. Its rounding error is recovered exactly (both factors are split into halves)
    and decides such cases.
    """
    x = F.col(x) if isinstance(x, str) else x
    x = x.cast("double")
    hundred = F.lit(100.0)
    splitter = F.lit(134217729.0)  # 2^27 + 1 splits a double into two exact halves
    scaled = x * hundred
    wide = splitter * x
    high = wide - (wide - x)
    low = x - high
    error = (high * hundred - scaled) + low * hundred
    floor = F.floor(scaled).cast("double")
    tie = (scaled - floor) == F.lit(0.5)
    rounded = (
        F.when(tie & (error > 0), floor + F.lit(1.0))
        .when(tie & (error < 0), floor)
        .otherwise(F.rint(scaled))
    )
    return rounded / hundred


def letterbox(
    width: Column | str,
    height: Column | str,
    new_width: int = 960,
    new_height: int = 960,
    auto: bool = True,
    scaleup: bool = True,
    stride: int = 32,
) -> Column:
    """Geometry of fitting an image into a fixed canvas with padding.

    Gives the scale, the resized size, the halved padding, and the four borders.
    """
    w = (F.col(width) if isinstance(width, str) else width).cast("double")
    h = (F.col(height) if isinstance(height, str) else height).cast("double")
    scale = F.least(F.lit(float(new_height)) / h, F.lit(float(new_width)) / w)
    if not scaleup:
        scale = F.least(scale, F.lit(1.0))
    inner_w, inner_h = half_even(w * scale), half_even(h * scale)
    pad_w, pad_h = F.lit(float(new_width)) - inner_w, F.lit(float(new_height)) - inner_h
    if auto:
        step = F.lit(float(stride))
        pad_w, pad_h = F.pmod(pad_w, step), F.pmod(pad_h, step)
    pad_w, pad_h = pad_w / F.lit(2.0), pad_h / F.lit(2.0)
    nudge = F.lit(0.1)
    return F.struct(
        scale.alias("ratio"),
        inner_w.cast("int").alias("inner_width"),
        inner_h.cast("int").alias("inner_height"),
        pad_w.alias("dw"),
        pad_h.alias("dh"),
        half_even(pad_h - nudge).cast("int").alias("top"),
        half_even(pad_h + nudge).cast("int").alias("bottom"),
        half_even(pad_w - nudge).cast("int").alias("left"),
        half_even(pad_w + nudge).cast("int").alias("right"),
    )


def unletterbox(ratio: Column, dw: Column, dh: Column) -> list[Column]:
    """Corners moved from canvas space back to image space, rounded to whole pixels."""
    shift = {"x0": dw, "x1": dw, "y0": dh, "y1": dh}
    return [half_even((F.col(c) - shift[c]) / ratio).cast("int").alias(c) for c in CORNERS]


def reflect(p: str, n: str) -> str:
    """SQL text: source index of position `p` in a line of `n`, mirrored about its end pixels."""
    folded = f"pmod({p}, greatest(2 * ({n} - 1), 1))"
    return f"if({n} = 1, 0, if({folded} < {n}, {folded}, 2 * ({n} - 1) - {folded}))"
