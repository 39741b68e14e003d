"""What a run records: log rows, summary, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_rows(redacted: DataFrame, passed: DataFrame, stamp: Column) -> DataFrame:
    """One typed row per finished object; both routes meet here.

    `redacted` carries its count of blurred boxes, a passed object counts 0.
    """
    both = redacted.select("file_name", "blurred_objects").unionByName(
        passed.select("file_name", F.lit(0).alias("blurred_objects"))
    )
    return both.select(
        F.col("file_name").cast("string").alias("file_name"),
        stamp.cast("timestamp").alias("datetime"),
        (F.col("blurred_objects") > 0).alias("blurred"),
        F.col("blurred_objects").cast("int").alias("blurred_objects"),
    )


def run_summary(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates seen, images blurred and boxes blurred, in one pass and one row.

    Candidates include the ones that were skipped later.
    """
    seen = candidates.select(F.lit(1).alias("c"), F.lit(0).alias("i"), F.lit(0).alias("o"))
    done = log.select(
        F.lit(0).alias("c"),
        F.col("blurred").cast("int").alias("i"),
        F.col("blurred_objects").alias("o"),
    )
    total = [
        F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias(name)
        for column, name in (("c", "processed"), ("i", "images_blurred"), ("o", "objects_blurred"))
    ]
    return seen.unionByName(done).agg(*total)


def quarantined(classified: DataFrame) -> DataFrame:
    """Names and reasons of the objects that failed the checks."""
    return classified.where(~F.col("valid")).select("file_name", "reason")


def quarantine_counts(classified: DataFrame) -> DataFrame:
    """Failed objects per reason; the names stay a table, however many there are."""
    return quarantined(classified).groupBy("reason").agg(F.count(F.lit(1)).alias("objects"))
