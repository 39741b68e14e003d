"""Bytes of candidates only, and listings as streams."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from veilframe.plans.scale import packed_parts
from veilframe.sources import fetch, objects
from veilframe.streaming import ingest as stream
from veilframe.streaming.listing import drained, stream_listing


def test_other_objects_are_not_opened(spark, tmp_path):
    """A pipe without a writer blocks whoever opens it."""
    (tmp_path / "a").mkdir()
    for name in ("a/one.jpg", "two%20[x] é.jpg"):
        (tmp_path / name).write_bytes(name.encode())
    listing = objects.scan_objects(spark, str(tmp_path)).collect()
    os.mkfifo(tmp_path / "pipe.jpg")
    candidates = spark.createDataFrame(listing).where("file_name <> 'a/one.jpg'")
    out = []
    reader = threading.Thread(target=lambda: out.append(objects.load_content(spark, candidates, str(tmp_path)).collect()), daemon=True)
    reader.start()
    reader.join(60)
    assert [(r["file_name"], bytes(r["content"])) for r in out[0]] == [("two%20[x] é.jpg", "two%20[x] é.jpg".encode())]


def test_plan_moves_no_bytes(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"{n:02d}.bin").write_bytes(bytes([n]) * 1000 * (n % 7 + 1))
    listing = objects.scan_objects(spark, str(tmp_path)).withColumn("note", F.array(F.lit("x"), F.lit(None)))
    loaded = fetch.fetched(listing, part_bytes=250_000)
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert loaded.rdd.getNumPartitions() > 8
    rows = loaded.collect()
    assert {r["file_name"]: bytes(r["content"]) for r in rows} == {f"{n:02d}.bin": bytes([n]) * 1000 * (n % 7 + 1) for n in range(40)}
    assert {(r["file_name"], r["last_modified"]) for r in rows} == {(r["file_name"], r["last_modified"]) for r in listing.collect()}
    assert all(r["note"] == ["x", None] for r in rows)


def test_batches_are_bounded(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fetch, "BATCH_BYTES", 25)
    paths = []
    for n in range(7):
        (tmp_path / str(n)).write_bytes(b"x" * 10 * n)
        paths.append(str(tmp_path / str(n)))
    rows = pa.RecordBatch.from_pydict({"path": [*paths, None, paths[0] + "gone"]})
    shape = pa.schema([("path", pa.string()), ("content", pa.binary())])
    batches = list(fetch.with_content(rows, shape))
    assert [[len(c or b"") for c in b.column("content").to_pylist()] for b in batches] == [[0, 10, 20], [30], [40], [50], [60], [0, 0]]
    assert pa.Table.from_batches(batches).column("path").to_pylist() == [*paths, None, paths[0] + "gone"]


def test_no_candidates_read_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "path string, length long, last_modified timestamp")
    loaded = objects.load_content(spark, none, str(tmp_path / "no such folder"))
    assert loaded.columns == ["path", "length", "last_modified", "content"]
    assert loaded.count() == 0


def test_null_paths_and_patterns(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"j")
    (tmp_path / "a.txt").write_bytes(b"t")
    rows = [(f"file:{tmp_path}/a.jpg", None), (f"file:{tmp_path}/a.txt", 1), (None, 1), ("file:/elsewhere/a.jpg", 1)]
    got = objects.load_content(spark, spark.createDataFrame(rows, "path string, length long"), str(tmp_path), "*.jpg")
    assert sorted((r["path"] or "", r["content"] and bytes(r["content"])) for r in got.collect()) == sorted(
        [(rows[0][0], b"j"), (rows[1][0], None), ("", None), (rows[3][0], None)]
    )


def test_packed_parts(spark):
    """Parts hold a contiguous run of weights, whatever partitions the rows were in."""
    df = spark.range(500).select("id", (F.col("id") % 13).alias("w"))
    rows, total = packed_parts(df, ["id"], F.col("w"), 100, "part")
    got = {r["id"]: r["part"] for r in rows.collect()}
    before, want = 0, {}
    for i in range(500):
        want[i], before = before // 100, before + i % 13
    assert got == want and total == before


def put(root, name, at, size=1):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"x" * size)
    os.utime(path, (at, at))


def test_listing_in_batches(spark, tmp_path):
    """Five batches over objects that arrive between them, with equal times and a restart in the middle."""
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    root.mkdir()

    def run():
        return stream.ingest(stream_listing(spark, str(root), limit=3), out, state)

    def names():
        return [r["file_name"] for r in spark.read.parquet(out).orderBy("last_modified", "file_name").collect()]

    now = time.time() - 1000
    for name in ("b", "a/x", "c", "d"):
        put(root, name, now, 7)  # four at the same time, a batch takes three
    put(root, "_temporary/part", now)
    run().awaitTermination()
    assert names() == ["a/x", "b", "c"]
    put(root, "e", now + 1)
    put(root, "f", now + 2)
    run().awaitTermination()  # a new query on the same checkpoint: the offset is remembered
    assert names() == ["a/x", "b", "c", "d", "e", "f"]
    run().awaitTermination()
    assert names() == ["a/x", "b", "c", "d", "e", "f"]
    put(root, "a/x", now + 3, 9)  # written anew
    put(root, "g", now + 3)
    put(root, "fresh", time.time() + 500)  # not settled yet
    runs = drained(run)
    assert len(runs) == 2
    assert names() == ["a/x", "b", "c", "d", "e", "f", "a/x", "g"]
    put(root, "late", now + 2.5)  # older than what has been taken: no part of the stream
    for n in range(5):
        put(root, f"h{n}", now + 4)
    drained(run)
    assert names()[-5:] == [f"h{n}" for n in range(5)]
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 13
    assert {(r["file_name"], r["length"]) for r in rows} >= {("a/x", 7), ("a/x", 9), ("b", 7)}


def test_listing_of_a_missing_folder(spark, tmp_path):
    run = stream.ingest(stream_listing(spark, str(tmp_path / "none")), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination()
    assert run.exception() is None


@pytest.mark.parametrize("settle", [0.0, 3600.0])
def test_settling(spark, tmp_path, settle):
    root = tmp_path / "in"
    put(root, "x", time.time() - 60)
    listing = stream_listing(spark, str(root), settle=settle)
    out = str(tmp_path / "out")
    stream.ingest(listing, out, str(tmp_path / "state")).awaitTermination()
    assert (spark.read.schema(listing.schema).parquet(out).count() if os.path.exists(out) else 0) == (settle == 0)
