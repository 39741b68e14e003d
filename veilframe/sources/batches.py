"""Batches whose objects and log rows appear together, and once.

A store is a folder. A batch stages its files where no reader looks: rewritten buckets of
objects and a table of log rows. Then one small manifest is renamed into place, and only
that makes the batch visible: it names the current folder of each bucket, the log rows it
adds, and the last batch of each writer. Readers follow committed manifests and nothing
else. A run that breaks off at any point leaves files that nobody reads; run again, the
batch is staged anew, or left alone if its manifest is there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.plans.scale import delete, scratch, written

BUCKETS = 256
BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer has committed meanwhile; the batch may be run again."""


@dataclass(frozen=True)
class Manifest:
    """The state of a store after a commit. Its size does not grow with the objects."""

    version: int = 0
    number: int = BUCKETS
    buckets: dict[str, str] = field(default_factory=dict)
    """The folder that holds each bucket."""
    log: str | None = None
    """The folder of the log rows that this commit adds."""
    done: dict[str, int] = field(default_factory=dict)
    """The last batch of each writer."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, which need not exist."""
    at = _path(spark, folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def _commits(spark: SparkSession, root: str) -> list[str]:
    return [name for name in _names(spark, f"{root}/commits") if name.endswith(".json") and name[0].isdigit()]


def newest(spark: SparkSession, root: str) -> Manifest:
    """The last committed state; an empty one for a store without a commit."""
    names = _commits(spark, root)
    if not names:
        return Manifest()
    return Manifest(**json.loads(spark.read.option("wholetext", "true").text(f"{root}/commits/{names[-1]}").first()[0]))


def _rows_at(spark: SparkSession, root: str, folders: dict[str, str]) -> DataFrame | None:
    paths = [f"{root}/objects/{folder}/{BUCKET}={bucket}" for bucket, folder in sorted(folders.items())]
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def read_objects(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all objects as last committed; `schema` is that of a store without any."""
    root = root.rstrip("/")
    rows = _rows_at(spark, root, newest(spark, root).buckets)
    return spark.createDataFrame([], schema or T.StructType()) if rows is None else rows


def _logs(spark: SparkSession, root: str) -> list[str]:
    """The log folder of each commit that has one: a short list, one name per batch."""
    if not _commits(spark, root):
        return []
    manifests = spark.read.schema("log string").json(f"{root}/commits/[0-9]*.json")
    return [r["log"] for r in manifests.where("log is not null").collect()]


def read_log(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The log rows of all commits, with `schema`; columns that early rows lack are null."""
    root = root.rstrip("/")
    folders = [f"{root}/log/{name}" for name in _logs(spark, root)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def stage_objects(state: Manifest, objects: DataFrame, root: str, key: str, attempt: str) -> dict[str, str]:
    """Write the touched buckets anew, with their other objects; their folders."""
    spark = objects.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(state.number)).cast("string")
    fresh = written(objects.withColumn(BUCKET, bucket))
    # at most as many as there are buckets
    touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())
    old = _rows_at(spark, root, {b: state.buckets[b] for b in touched if b in state.buckets})
    rows = fresh
    if old is not None:
        kept = old.join(fresh.select(key).distinct(), key, "left_anti").withColumn(BUCKET, bucket)
        rows = fresh.unionByName(kept, allowMissingColumns=True)
    if touched:
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/objects/{attempt}")
    return dict.fromkeys(touched, attempt)


def stage_log(log: DataFrame, root: str, attempt: str) -> str | None:
    """Write the log rows; their folder."""
    log.write.parquet(f"{root}/log/{attempt}")
    return attempt


def publish(spark: SparkSession, root: str, manifest: Manifest, attempt: str) -> None:
    """Put the manifest in place by one rename, which fails if that version exists."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    aside, final = _path(spark, f"{root}/commits/_{attempt}"), _path(spark, f"{root}/commits/{manifest.version:010d}.json")
    stream = aside.getFileSystem(conf).create(aside, True)
    stream.write(json.dumps(asdict(manifest)).encode())
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never = spark.sparkContext._gateway.new_array(rename, 1)
    never[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf)
    try:
        context.rename(aside, final, never)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        raise CommitConflict(f"version {manifest.version} of {root} exists") from error


def commit_batch(
    root: str, writer: str, batch: int, objects: DataFrame, log: DataFrame, key: str, buckets: int = BUCKETS
) -> bool:
    """Replace objects (all rows of a `key`) and add log rows, both or neither; whether it was needed.

    A batch up to the writer's last committed one is left alone. The number of buckets stays
    with the store. Only touched buckets are read and rewritten. The store must be able to
    rename a file; with several writers the rename must be atomic too.
    """
    spark, root = objects.sparkSession, root.rstrip("/")
    state = newest(spark, root)
    if state.done.get(writer, -1) >= batch:
        return False
    if not state.version:
        state = Manifest(number=buckets)
    elif state.number != buckets:
        raise ValueError(f"{root} has {state.number} buckets, not {buckets}")
    attempt = f"{state.version + 1:010d}-{uuid.uuid4().hex}"
    with scratch():
        folders = stage_objects(state, objects, root, key, attempt)
        entry = stage_log(log, root, attempt)
    after = Manifest(state.version + 1, buckets, state.buckets | folders, entry, state.done | {writer: batch})
    publish(spark, root, after, attempt)
    return True


def clean(spark: SparkSession, root: str) -> int:
    """Delete staged and replaced folders that no manifest needs, and count them.

    Run it when no batch is running and nobody reads an older state.
    """
    root = root.rstrip("/")
    current = set(newest(spark, root).buckets.values())
    committed = set(_logs(spark, root))
    gone = [f"{root}/objects/{n}" for n in _names(spark, f"{root}/objects") if n not in current]
    gone += [f"{root}/log/{n}" for n in _names(spark, f"{root}/log") if n not in committed]
    gone += [f"{root}/commits/{n}" for n in _names(spark, f"{root}/commits") if n.startswith("_")]
    for path in gone:
        delete(spark, path)
    return len(gone)
