"""Object listings and object bytes."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.fetch import fetched


def _reader(spark: SparkSession, pattern: str | None):
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", pattern) if pattern else reader


STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
"""Scheme and authority in front of a path."""


def below(root: str) -> str:
    """What the paths of all objects below `root` start with, behind scheme and authority."""
    return re.sub(STORE, "", root).rstrip("/") + "/"


def with_relative_path(df: DataFrame, root: str, name: str = "file_name") -> DataFrame:
    """Add the path below `root`, an absolute path or a store URI; null for paths elsewhere."""
    folder = below(root)
    path: Column = F.regexp_replace("path", STORE, "")
    tail = F.substring(path, F.lit(len(folder) + 1), F.length(path))
    return df.withColumn(name, F.when(F.startswith(path, F.lit(folder)), tail))


def scan_objects(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """All objects under `root` with time and size; no bytes are read."""
    listing = _reader(spark, pattern).load(root).select("path", "modificationTime", "length")
    return with_relative_path(listing, root).select(
        "path", "file_name", F.col("modificationTime").alias("last_modified"), "length"
    )


def load_content(
    spark: SparkSession, candidates: DataFrame, root: str, pattern: str | None = None,
    fetch: bool = True,
) -> DataFrame:
    """Add `content` to the candidates below `root` whose base name fits `pattern`, if there is one.

    No other object is opened. Candidates that are gone, lie elsewhere or do not fit have
    null content. With `fetch` off all have.
    """
    nothing = F.lit(None).cast("binary")
    if not fetch:
        return candidates.withColumn("content", nothing)
    wanted = F.startswith(F.regexp_replace("path", STORE, ""), F.lit(below(root)))
    if pattern:
        wanted &= F.element_at(F.split("path", "/"), -1).rlike(fnmatch.translate(pattern))
    wanted = F.coalesce(wanted, F.lit(False))
    return fetched(candidates.where(wanted)).unionByName(candidates.where(~wanted).withColumn("content", nothing))


def scan_frames(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """Frames that lie directly in one folder."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    listing = reader.load(folder).select("path", "modificationTime", "length")
    return listing.withColumn("frame_name", F.element_at(F.split("path", "/"), -1))
