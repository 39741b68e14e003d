"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted suffixes.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
VIDEO_SUFFIXES = (".MP4", ".mp4", ".AVI", ".avi", ".MOV", ".mov")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ends_with_any(c: Column, suffixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for suffix in suffixes:
        test = test | c.endswith(suffix)
    return test


def is_image(name: Column | str) -> Column:
    """True for image suffixes in any case."""
    return _ends_with_any(F.lower(_col(name)), IMAGE_SUFFIXES)


def is_video(name: Column | str) -> Column:
    """True for the exact video suffixes; mixed case does not count."""
    return _ends_with_any(_col(name), VIDEO_SUFFIXES)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def dir_by_replace(path: Column | str) -> Column:
    """The path with every occurrence of its base name removed.

    Differs from `dir_name` when a folder contains the base name as text.
    """
    return F.replace(_col(path), base_name(path), F.lit(""))


def dir_name(path: Column | str) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_replace(_col(path), "[^/]*$", "")


def join_path(head: Column | str, tail: Column | str) -> Column:
    """Join two path parts: an absolute tail wins, and no slash is doubled."""
    head, tail = _col(head), _col(tail)
    return (
        F.when(tail.startswith("/"), tail)
        .when((head == "") | head.endswith("/"), F.concat(head, tail))
        .otherwise(F.concat(head, F.lit("/"), tail))
    )


def relative_path(path: Column | str, root: str) -> Column:
    """The part of `path` below `root`."""
    return F.substring(_col(path), len(root.rstrip("/")) + 2, 2**31 - 1)


def blurred_name(path: Column | str) -> Column:
    """Output name of a single-file run: every dot gets the marker before it."""
    return F.replace(_col(path), F.lit("."), F.lit("_blurred."))


def square_size(model_name: Column | str) -> Column:
    """Side of a square model input, from the first dash-separated part with `px` in it."""
    parts = F.filter(F.split(_col(model_name), "-"), lambda part: part.contains("px"))
    side = F.replace(F.get(parts, F.lit(0)), F.lit("px"), F.lit("")).try_cast("int")
    checked = F.coalesce(
        side, F.raise_error(F.concat(F.lit("no pixel size in "), _col(model_name))).cast("int")
    )
    return F.struct(checked.alias("width"), checked.alias("height"))


def stem_number(name: Column | str, strict: bool = True) -> Column:
    """The name up to its first dot as a number; a non-number fails when strict."""
    number = F.get(F.split(_col(name), "[.]"), F.lit(0)).try_cast("bigint")
    if not strict:
        return number
    message = F.concat(F.lit("frame name without a number: "), _col(name))
    return F.coalesce(number, F.raise_error(message).cast("bigint"))
