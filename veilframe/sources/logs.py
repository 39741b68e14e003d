"""The process log: what earlier runs have finished."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.model import LOG_SCHEMA


def read_log(spark: SparkSession, table: str) -> DataFrame:
    """Logged names from a catalog table; a table that does not exist yet is empty."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], LOG_SCHEMA).select("file_name")
    return spark.table(table).select("file_name")


def append_log(rows: DataFrame, table: str, fmt: str = "parquet") -> None:
    """Append typed log rows to a catalog table, adding columns it lacks."""
    spark = rows.sparkSession
    if fmt != "parquet":
        rows.write.format(fmt).mode("append").option("mergeSchema", "true").saveAsTable(table)
        return
    if not spark.catalog.tableExists(table):
        rows.write.format(fmt).saveAsTable(table)
        return
    known = spark.table(table).columns
    added = [f for f in rows.schema if f.name not in known]
    if added:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
    target = spark.table(table).schema
    aligned = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target
    ]
    rows.select(*aligned).write.format(fmt).mode("append").saveAsTable(table)


def read_log_path(spark: SparkSession, path: str) -> DataFrame:
    """All log columns from a folder of parquet files, with columns merged.

    Only a folder that does not exist counts as an empty log; other errors are raised.
    """
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def append_log_path(rows: DataFrame, path: str) -> None:
    """Append log rows to a folder of parquet files; readers merge the columns."""
    rows.write.mode("append").parquet(path)
