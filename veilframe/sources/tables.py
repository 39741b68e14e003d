"""Tabular inputs: detections, rasters, frames, classes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veilframe import model


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A stored table of a known schema, read without inference."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, model.DETECTION_SCHEMA)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, model.RASTER_SCHEMA)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, model.FRAME_SCHEMA)


def class_table(spark: SparkSession, names: dict[int, str] | list[str] | Any) -> DataFrame:
    """A class dictionary from options: an id-to-name mapping or a list of names."""
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    return spark.createDataFrame([(int(i), n) for i, n in pairs], model.CLASS_SCHEMA)
