"""Sinks: replace, write once, reload, quarantine, folder layout.

Partitioned writes carry a rebalance hint, so that a partition gets a few large files
and a hot one is split over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.paths import dir_by_replace
from veilframe.plans.scale import joined, written


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _overwrite_partitions(df: DataFrame, path: str, *parts: str) -> None:
    writer = df.hint("rebalance", *parts).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def replace_by_key(df: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """Write objects over their former version and leave all others as they are.

    Objects live in hash buckets. Only touched buckets are read and rewritten: their
    untouched objects are carried over. `df` is written aside first, so that names and
    rows are the same ones. The number of buckets stays with the target; another is refused.
    """
    _replaced(df, path, key, buckets, lambda old, keys: old.join(keys, key, "left_anti"))


def _replaced(
    df: DataFrame, path: str, key: str, buckets: int, others: Callable[[DataFrame, DataFrame], DataFrame], wider: bool = False
) -> None:
    """Write `df` and, of touched buckets, `others(old rows, keys of df)`; `wider` allows other columns."""
    spark, mark = df.sparkSession, f"{path.rstrip('/')}/_buckets"
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = written(df.withColumn("bucket", bucket))
    old = _existing(spark, path)
    if old is not None:
        known = _existing(spark, mark)
        before = known.first()["buckets"] if known is not None else None
        if before != buckets:
            raise ValueError(f"{path} has {before} buckets, not {buckets}")
        # at most `buckets` rows
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
        kept = others(old.where(F.col("bucket").isin(touched)), fresh.select(key).distinct())
        fresh = written(fresh.unionByName(kept, allowMissingColumns=wider))
    else:
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(mark)
    _overwrite_partitions(fresh, path, "bucket")


def write_once(df: DataFrame, path: str) -> None:
    """Write a target that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def add_once(df: DataFrame, path: str, key: str) -> None:
    """Add objects of which none may exist yet."""
    old = _existing(df.sparkSession, path)
    if old is not None and not old.join(df.select(key).distinct(), key, "left_semi").isEmpty():
        raise ValueError(f"some {key} values exist already in {path}")
    df.write.mode("append").parquet(path)


def published(spark: SparkSession, path: str, key: str = "output_path") -> DataFrame | None:
    """The keys that `add_once` has written, or None before the first."""
    old = _existing(spark, path)
    return None if old is None else old.select(key).distinct()


def reload_frames(frames: DataFrame, path: str, buckets: int = 256) -> None:
    """Replace all frames of the videos in `frames`; other videos stay.

    Videos share hash buckets as the objects of `replace_by_key` do, so files are as many as
    buckets, however many videos there are. Frames without a video id are one video.
    """
    others = lambda old, videos: joined(old, videos, ["video_id"], "left_anti")
    _replaced(frames, path, "video_id", buckets, others, wider=True)


def write_quarantine(bad: DataFrame, path: str) -> bool:
    """Write the names of bad objects as text, one per line; nothing when there are none."""
    names = bad.select("file_name")
    if names.isEmpty():
        return False
    names.write.mode("overwrite").text(path)
    return True


def write_by_folder(df: DataFrame, path: str, name: str = "file_name") -> None:
    """Write objects in the folders of their names."""
    _overwrite_partitions(df.withColumn("dir", dir_by_replace(name)), path, "dir")
