"""Guards that keep plans safe when one key holds much of the data.

Groups are counted first (a partial aggregation, so a hot key costs one row per
map task). Only groups under a stated size are handled inside one task; the rest
take a path that splits them.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import fields, is_dataclass
from functools import reduce, wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL_ROWS = 10_000
"""Largest table, in rows, that is broadcast."""

SMALL_IDS = 500_000
"""Largest list of single numbers, in rows, that is broadcast (a few megabytes)."""

FOLD_LIMIT = 512
"""Largest group that is folded as one array; the work is quadratic in its kept boxes."""

HOT_ROWS = 1_000_000
"""Largest group that is sorted by one window task."""


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
    return spark.sparkContext.getCheckpointDir()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for written tables inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""Whether Spark deletes the shuffle files of a query at its end, not when the driver collects its garbage."""


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that begin here leave no shuffle files."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to a table in the shared folder and read them back.

    Unlike an RDD checkpoint the rows are computed once, and later reads prune columns and
    push filters down. The table survives lost executors. Inside `scratch` it is deleted at
    the end of the scope. What was shuffled for it goes when it is written.
    """
    path = work_dir(df.sparkSession, "step")
    with short_shuffles(df.sparkSession):
        df.write.parquet(path)
    if (own := _scope.get()) is not None:
        own.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scope: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scope", default=None)
"""Tables that the innermost scope has written so far."""

STEP = re.compile(r"step-[0-9a-f]{32}")
"""The folder of a written table."""


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def frames_in(result: Any) -> list[DataFrame]:
    """The tables of a result: a table, or tables in a mapping, a sequence or a dataclass."""
    if isinstance(result, DataFrame):
        return [result]
    if isinstance(result, Mapping):
        return [df for part in result.values() for df in frames_in(part)]
    if is_dataclass(result):
        return [df for f in fields(result) for df in frames_in(getattr(result, f.name))]
    if isinstance(result, Sequence) and not isinstance(result, str):
        return [df for part in result for df in frames_in(part)]
    return []


def steps_of(*results: Any) -> set[str]:
    """Folder names of the written tables that results read."""
    files = [file for part in results for df in frames_in(part) for file in df.inputFiles()]
    return {m[0] for file in files if (m := STEP.search(file))}


class Scratch:
    """The written tables of a scope."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []
        self.kept: set[str] = set()

    def keep(self, *results: Any) -> None:
        """Leave the tables that these results read to the scope around this one."""
        self.kept |= steps_of(*results)

    def drop(self, *results: Any) -> None:
        """Delete the tables of this scope that these results read, after their last use."""
        gone = steps_of(*results)
        for entry in [t for t in self.tables if t[1].rpartition("/")[2] in gone]:
            self.tables.remove(entry)
            delete(*entry)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """A scope at whose end its written tables are deleted, also after an error.

    Tables of kept results belong to the scope around it from then on; if there is none
    they stay until `release`.
    """
    scope, failed = Scratch(), True
    token = _scope.set(scope.tables)
    try:
        yield scope
        failed = False
    finally:
        _scope.reset(token)
        outer = _scope.get()
        for spark, path in scope.tables:
            if failed or path.rpartition("/")[2] not in scope.kept:
                delete(spark, path)
            elif outer is not None:
                outer.append((spark, path))


def tidy[**P, R](work: Callable[P, R]) -> Callable[P, R]:
    """Delete what a function writes on the way; the tables that its result reads stay."""

    @wraps(work)
    def run(*args: P.args, **kwargs: P.kwargs) -> R:
        with scratch() as scope:
            result = work(*args, **kwargs)
            scope.keep(result)
        return result

    return run


def release(result: Any) -> None:
    """Delete the written tables that a result reads, when nothing reads the result any more."""
    spark = next(df.sparkSession for df in frames_in(result))
    for name in steps_of(result):
        delete(spark, f"{shared_dir(spark).rstrip('/')}/{name}")


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a side for broadcast only when it is counted to be small."""
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else df


def restricted(df: DataFrame, ids: DataFrame, key: str, max_rows: int = SMALL_IDS) -> DataFrame:
    """Rows of `df` whose `key` occurs in `ids`, safe for a hot key.

    A small list is broadcast, so nothing moves. A large one needs a shuffle; its result is
    written, because a join that feeds a grouping on the same key is not split when skewed.
    """
    if ids.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(ids), key, "left_semi")
    return written(df.join(ids, key, "left_semi"))


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than `limit` rows, or None when there are none."""
    heavy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    heavy = heavy.select(*keys)
    head = heavy.take(SMALL_ROWS + 1)
    if not head:
        return None
    if len(head) <= SMALL_ROWS:
        return F.broadcast(df.sparkSession.createDataFrame(head, heavy.schema))
    return written(heavy)


def same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    """Null-safe equality over `keys` of two aliased frames."""
    return reduce(
        lambda p, q: p & q, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    )


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null is a value like any other."""
    both = left.alias("l").join(right.alias("r"), same_keys("l", "r", keys), how)
    more = [] if how in ("left_anti", "left_semi") else [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return both.select("l.*", *more)


def _ranged(df: DataFrame, order: Sequence[Column | str], weight: Column) -> tuple[DataFrame, int]:
    """Rows sorted over range partitions, with `_part`, `_mid` and `_start`; and the total weight.

    The rows are written once, so that partition numbers are settled. `_mid` ascends within
    a partition, and `_start` is the weight of the partitions before.
    """
    placed = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mid", 33))
    # one row per partition, so this list is bounded by the number of tasks
    sizes = placed.groupBy("_part").agg(F.sum(weight).alias("_n")).collect()
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((row["_part"], total))
        total += row["_n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    return placed.join(F.broadcast(offsets), "_part"), total


def positioned(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add the 0-based position of each row in a global order, without one global task.

    The position is the size of the range partitions before plus the place within the
    partition. `order` should be total, so that ties split.
    """
    placed, _ = _ranged(df, order, F.lit(1).cast("bigint"))
    place = F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, place.alias(name))


def packed_parts(
    df: DataFrame, order: Sequence[Column | str], weight: Column, size: int, name: str
) -> tuple[DataFrame, int]:
    """Add the number of the part that a row belongs to, and return the total weight.

    A part is what starts within the next `size` of weight, in a global order.
    """
    placed, total = _ranged(df, order, weight)
    before = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_start") + F.coalesce(F.sum(weight).over(before), F.lit(0))
    return placed.withColumn(name, F.floor(at / F.lit(size)).cast("int")).select(*df.columns, name), total


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    start: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of each group in a total order.

    Groups that fit one task are numbered by a window. The rows of larger ones, and no
    others, are range-partitioned over their whole order, which splits a group, and get
    their number from the sizes of the partitions and the start of their group.
    """
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return _by_window(df, keys, order, name, start)
    cold, split = (joined(df, hot, keys, how) for how in ("left_anti", "left_semi"))
    return _by_window(cold, keys, order, name, start).unionByName(_by_ranges(split, keys, order, name, start))


def _by_window(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, start: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window) + F.lit(start - 1))


def _by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, start: int) -> DataFrame:
    placed = positioned(df, [*keys, *order], "_pos")
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    number = (F.col("_pos") - F.col("_first") + F.lit(start)).cast("int")
    return joined(placed, small(first), keys).select(*df.columns, number.alias(name))
