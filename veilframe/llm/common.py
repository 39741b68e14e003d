"""Helpers that several corpus operators share."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns inside one struct `_row`, so that helper columns cannot clash with them."""
    return df.select(
        F.struct(*[quoted(c) for c in df.columns]).alias("_row"),
        *[c.alias(n) for n, c in extra.items()],
    )


def unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col("_row")[c].alias(c) for c in columns])


def id_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table from literal rows, kept inside the plan."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    of = f"array<struct<{', '.join(p.replace(' ', ': ', 1) for p in schema.split(', '))}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), of)))


def parts(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))
