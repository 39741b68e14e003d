"""Batches that commit objects and log rows together: crashes at each step, reruns, other writers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.sources import batches
from veilframe.streaming import ingest as stream

LOG = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])
OBJECTS = "name string, line int, value int"


class Crash(RuntimeError):
    pass


def batch(spark, number, names):
    objects = spark.createDataFrame([(n, line, number) for n in names for line in range(3)], OBJECTS)
    return objects, spark.createDataFrame([(n, number) for n in names], LOG)


def state(spark, root):
    objects = batches.read_objects(spark, root, T._parse_datatype_string(OBJECTS))
    log = batches.read_log(spark, root, LOG)
    return sorted(map(tuple, objects.collect())), sorted(map(tuple, log.collect()))


def lines(**values):
    return sorted((n, line, v) for n, v in values.items() for line in range(3))


def test_commits(spark, tmp_path):
    root = str(tmp_path / "store") + "/"
    assert state(spark, root) == ([], [])
    assert batches.commit_batch(root, "w", 0, *batch(spark, 0, "abc"), key="name", buckets=4)
    assert batches.commit_batch(root, "w", 1, *batch(spark, 1, "bd"), key="name", buckets=4)
    assert state(spark, root) == (lines(a=0, b=1, c=0, d=1), sorted([("a", 0), ("b", 0), ("c", 0), ("b", 1), ("d", 1)]))
    assert not batches.commit_batch(root, "w", 1, *batch(spark, 9, "a"), key="name", buckets=4)
    assert not batches.commit_batch(root, "w", 0, *batch(spark, 9, "a"), key="name", buckets=4)
    assert batches.commit_batch(root, "other", 0, *batch(spark, 5, "a"), key="name", buckets=4)
    assert batches.commit_batch(root, "w", 2, *batch(spark, 6, ""), key="name", buckets=4)
    assert state(spark, root)[0] == lines(a=5, b=1, c=0, d=1)
    with pytest.raises(ValueError, match="buckets"):
        batches.commit_batch(root, "w", 3, *batch(spark, 9, "a"), key="name", buckets=8)
    before = state(spark, root)
    assert batches.clean(spark, root) > 0
    assert state(spark, root) == before
    assert batches.clean(spark, root) == 0


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("step", ["stage_objects", "stage_log", "publish"])
def test_crash_at_each_step(spark, tmp_path, monkeypatch, step, when):
    root, real = str(tmp_path / "store"), getattr(batches, step)
    batches.commit_batch(root, "w", 0, *batch(spark, 0, "abc"), key="name", buckets=4)

    def broken(*args, **kwargs):
        if when == "after":
            real(*args, **kwargs)
        raise Crash

    monkeypatch.setattr(batches, step, broken)
    with pytest.raises(Crash):
        batches.commit_batch(root, "w", 1, *batch(spark, 1, "bd"), key="name", buckets=4)
    done = (step, when) == ("publish", "after")
    new = (lines(a=0, b=1, c=0, d=1), sorted([("a", 0), ("b", 0), ("c", 0), ("b", 1), ("d", 1)]))
    assert state(spark, root) == (new if done else (lines(a=0, b=0, c=0), [("a", 0), ("b", 0), ("c", 0)]))
    monkeypatch.setattr(batches, step, real)
    assert batches.commit_batch(root, "w", 1, *batch(spark, 1, "bd"), key="name", buckets=4) is not done
    assert state(spark, root) == new
    batches.clean(spark, root)
    assert state(spark, root) == new


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """The second of two batches on the same state is refused, and succeeds when run again."""
    root, real = str(tmp_path / "store"), batches.publish

    def late(spark_, root_, manifest, attempt):
        monkeypatch.setattr(batches, "publish", real)
        batches.commit_batch(root, "first", 0, *batch(spark, 1, "ab"), key="name", buckets=4)
        real(spark_, root_, manifest, attempt)

    monkeypatch.setattr(batches, "publish", late)
    with pytest.raises(batches.CommitConflict):
        batches.commit_batch(root, "second", 0, *batch(spark, 2, "bc"), key="name", buckets=4)
    assert state(spark, root)[0] == lines(a=1, b=1)
    assert batches.commit_batch(root, "second", 0, *batch(spark, 2, "bc"), key="name", buckets=4)
    assert state(spark, root)[0] == lines(a=1, b=2, c=2)


def test_stream_of_batches(spark, tmp_path, monkeypatch):
    """Three batches; the second one fails after its commit and is run again by a restart."""
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "store", "state"))
    for n in range(3):
        spark.createDataFrame([(f"o{n}", n), (f"o{n}", n), ("shared", n)], LOG).coalesce(1).write.mode("append").parquet(source)

    def work(rows, log):
        rows = rows.join(log.where("name = 'shared'").groupBy().agg(F.count(F.lit(1)).alias("seen")), how="cross")
        return rows.select("name", F.col("seen").cast("int").alias("value")), rows.select("name", "n")

    def run():
        rows = stream.stream_table(spark, source, LOG, files=1)
        return stream.committed_batches(rows, work, root, checkpoint, "name", "name", LOG, buckets=4)

    real, calls = batches.publish, []

    def broken(*args):
        real(*args)
        calls.append(1)
        if len(calls) == 2:
            raise Crash

    monkeypatch.setattr(batches, "publish", broken)
    with pytest.raises(Exception, match="Crash"):
        run().awaitTermination()
    run().awaitTermination()
    assert len(calls) == 3
    objects = {r["name"]: r["value"] for r in batches.read_objects(spark, root).collect()}
    assert objects["shared"] == 2 and sorted(objects) == ["o0", "o1", "o2", "shared"]
    assert sorted(r["name"] for r in batches.read_log(spark, root, LOG).collect()) == ["o0", "o1", "o2", "shared", "shared", "shared"]
