"""Choosing which objects to work on, before any bytes are read."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.paths import is_image

# Leading bytes of the image formats, in hexadecimal.
SIGNATURES = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A"}


def not_excluded(name: Column | str, token: str) -> Column:
    """True unless the case-sensitive token occurs anywhere in the name."""
    name = F.col(name) if isinstance(name, str) else name
    return ~name.contains(token)


def recent(ts: Column | str, as_of: Column, lookback: timedelta) -> Column:
    """Known time, not older than the look-back; the cut-off itself counts."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = int(lookback.total_seconds())
    cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return ts.isNotNull() & (ts >= cutoff)


def unprocessed(objects: DataFrame, log: DataFrame) -> DataFrame:
    """Objects whose name is not in the log.

    Log names are made distinct first: the combine runs map-side, so copies of a name
    never pile up in one task, and its hash partitioning serves the join as well.
    """
    return objects.join(log.select("file_name").distinct(), "file_name", "left_anti")


def unprocessed_names(objects: DataFrame, log: DataFrame) -> DataFrame:
    """The set difference of names alone."""
    return objects.select("file_name").subtract(log.select("file_name"))


def candidates(
    objects: DataFrame,
    log: DataFrame,
    as_of: Column,
    lookback: timedelta = timedelta(hours=24),
    exclude: str = "00_UNSORTED",
) -> DataFrame:
    """Recent, included images that no earlier run has logged."""
    wanted = objects.where(
        is_image("file_name")
        & not_excluded("file_name", exclude)
        & recent("last_modified", as_of, lookback)
    )
    return unprocessed(wanted, log)


def large_enough(min_bytes: int = 1024) -> Column:
    return F.col("length") >= F.lit(min_bytes)


def classify(objects: DataFrame, min_bytes: int = 1024, signature: bool = True) -> DataFrame:
    """Add `valid` and `reason`: missing, too small, unreadable, in that order.

    With `signature` the leading bytes of `content` are compared with the known formats.
    """
    reason = F.when(F.col("length").isNull(), F.lit("missing")).when(
        ~large_enough(min_bytes), F.lit("too small")
    )
    if signature:
        known = F.lit(False)
        for head in SIGNATURES.values():
            start = F.hex(F.substring("content", 1, len(head) // 2))
            known = known | (start == F.lit(head))
        reason = reason.when(~F.coalesce(known, F.lit(False)), F.lit("unreadable"))
    return objects.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def with_metadata(objects: DataFrame, metadata: DataFrame) -> DataFrame:
    """Objects with their recorded altitude and size, null where unknown."""
    return objects.join(metadata, "file_name", "left")


def with_altitude(objects: DataFrame) -> DataFrame:
    """Objects of known altitude; the others are retried by a later run."""
    return objects.where(F.col("altitude").isNotNull())


def route(objects: DataFrame, min_altitude: float) -> DataFrame:
    """Mark objects below the threshold for redaction and let the others pass."""
    below = F.col("altitude") < F.lit(float(min_altitude))
    return objects.withColumn("route", F.when(below, "redact").otherwise("pass"))


def split_routes(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two branches as frames, so that scoring never sees the passing rows."""
    return routed.where(F.col("route") == "redact"), routed.where(F.col("route") == "pass")


def missing_inputs(requested: DataFrame, objects: DataFrame) -> DataFrame:
    """Requested names that the listing does not have."""
    return requested.join(objects.select("file_name").distinct(), "file_name", "left_anti")


def on_list(name: Column | str, classes: Sequence[str]) -> Column:
    """Membership of a class list given as options."""
    name = F.col(name) if isinstance(name, str) else name
    return name.isin(*classes)
