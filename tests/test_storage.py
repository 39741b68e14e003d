import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilframe.model import LOG_SCHEMA
from veilframe.operators import runlog
from veilframe.operators import selection as S
from veilframe.sources import logs, objects, sinks, tables

JPEG, PNG = bytes.fromhex("FFD8FFE0"), bytes.fromhex("89504E470D0A1A0A")


@pytest.fixture
def store(tmp_path):
    root = tmp_path / "store"
    files = {
        "a/one.jpg": JPEG + b"x" * 2000,
        "a/two.PNG": PNG + b"x" * 2000,
        "b/c/small.jpg": JPEG + b"x" * 10,
        "b/fake.jpeg": b"GIF89a" + b"x" * 2000,
        "notes.txt": b"hello",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root


def test_scan_lists_without_reading(spark, store):
    listing = objects.scan_objects(spark, str(store))
    assert {r["file_name"] for r in listing.collect()} == {
        "a/one.jpg", "a/two.PNG", "b/c/small.jpg", "b/fake.jpeg", "notes.txt"
    }
    plan = listing.where(S.large_enough())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(length,1024)" in plan
    assert "content" not in plan


def test_content_and_quarantine(spark, store, tmp_path):
    listing = objects.scan_objects(spark, str(store)).where(F.lower("file_name").rlike("[.](jpe?g|png)$"))
    loaded = objects.load_content(spark, listing, str(store))
    checked = S.classify(loaded)
    reasons = {r["file_name"]: r["reason"] for r in checked.collect()}
    assert reasons == {
        "a/one.jpg": None, "a/two.PNG": None, "b/c/small.jpg": "too small", "b/fake.jpeg": "unreadable"
    }
    target = str(tmp_path / "bad")
    assert sinks.write_quarantine(runlog.quarantined(checked), target)
    assert {r[0] for r in spark.read.text(target).collect()} == {"b/c/small.jpg", "b/fake.jpeg"}
    good = checked.where("valid")
    assert not sinks.write_quarantine(runlog.quarantined(good), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    counts = {r["reason"]: r["objects"] for r in runlog.quarantine_counts(checked).collect()}
    assert counts == {"too small": 1, "unreadable": 1}


def test_content_of_nothing_and_without_fetch(spark, store):
    listing = objects.scan_objects(spark, str(store))
    assert objects.load_content(spark, listing.where("false"), str(store)).count() == 0
    assert objects.load_content(spark, listing, str(store), fetch=False).where("content is null").count() == 5


def test_content_of_all(spark, store):
    listing = objects.scan_objects(spark, str(store))
    assert objects.load_content(spark, listing, str(store)).where("octet_length(content) = length").count() == 5


def test_missing_object_is_a_reason(spark):
    df = spark.createDataFrame([("x.jpg", None)], "file_name string, length bigint")
    assert S.classify(df, signature=False).first()["reason"] == "missing"


def test_frame_folder(spark, store):
    frames = objects.scan_frames(spark, str(store / "a"))
    assert [r["frame_name"] for r in frames.collect()] == ["one.jpg"]


def log_df(spark, *names):
    now = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(n, now, True, 2) for n in names], LOG_SCHEMA)


def test_log_table(spark):
    assert logs.read_log(spark, "run_log").count() == 0
    logs.append_log(log_df(spark, "a", "b"), "run_log")
    logs.append_log(log_df(spark, "c").withColumn("model", F.lit("m1")), "run_log")
    logs.append_log(log_df(spark, "d"), "run_log")
    assert {r[0] for r in logs.read_log(spark, "run_log").collect()} == set("abcd")
    assert {(r["file_name"], r["model"]) for r in spark.table("run_log").collect()} == {
        ("a", None), ("b", None), ("c", "m1"), ("d", None)
    }
    assert dict(spark.table("run_log").dtypes)["blurred_objects"] == "int"


def test_log_folder(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.read_log_path(spark, path).count() == 0
    logs.append_log_path(log_df(spark, "a"), path)
    logs.append_log_path(log_df(spark, "b").withColumn("model", F.lit("m1")), path)
    assert {(r["file_name"], r["model"]) for r in logs.read_log_path(spark, path).collect()} == {
        ("a", None), ("b", "m1")
    }


def test_unreadable_log_is_an_error(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        logs.read_log_path(spark, str(tmp_path / "log")).count()


def test_replace_by_key(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.range(100).select(F.col("id").cast("string").alias("file_name"), F.lit(1).alias("v"))
    sinks.replace_by_key(first, path, "file_name", buckets=4)
    new = spark.range(95, 105).select(F.col("id").cast("string").alias("file_name"), F.lit(2).alias("v"))
    sinks.replace_by_key(new, path, "file_name", buckets=4)
    sinks.replace_by_key(new, path, "file_name", buckets=4)
    with pytest.raises(ValueError, match="4 buckets"):
        sinks.replace_by_key(new, path, "file_name", buckets=8)
    sinks.replace_by_key(new.limit(0), path, "file_name", buckets=4)
    rows = {r["file_name"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert rows == {str(i): 1 if i < 95 else 2 for i in range(105)}
    assert spark.read.parquet(path).count() == 105


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "file_name string")
    sinks.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_once(df, str(tmp_path / "once"))
    with pytest.raises(ValueError):
        sinks.add_once(df, str(tmp_path / "once"), "file_name")
    sinks.add_once(df.select(F.concat("file_name", F.lit("2")).alias("file_name")), str(tmp_path / "once"), "file_name")
    assert spark.read.parquet(str(tmp_path / "once")).count() == 4


def test_reload_frames(spark, tmp_path):
    path = str(tmp_path / "frames")
    frames = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "video_id bigint, frame_idx int")
    sinks.reload_frames(frames, path)
    sinks.reload_frames(spark.createDataFrame([(1, 7)], frames.schema), path)
    assert {(r["video_id"], r["frame_idx"]) for r in spark.read.parquet(path).collect()} == {(1, 7), (2, 0)}


def test_reload_has_as_many_files_as_buckets(spark, tmp_path):
    """Hundreds of videos, one without an id, and a second load with one more column."""
    path = str(tmp_path / "frames")
    videos = spark.range(600).selectExpr("if(id = 0, null, id) as video_id", "0 as n")
    sinks.reload_frames(videos, path, buckets=8)
    some = videos.where("video_id is null or video_id % 3 = 0").selectExpr("video_id", "1 as n", "'x' as tag")
    sinks.reload_frames(some, path, buckets=8)
    back = spark.read.parquet(path)
    assert len(back.inputFiles()) <= 8
    want = {(None if i == 0 else i, int(i % 3 == 0)) for i in range(600)}
    got = [(r["video_id"], r["n"]) for r in back.collect()]
    assert len(got) == 600 and set(got) == want
    with pytest.raises(ValueError, match="buckets"):
        sinks.reload_frames(some, path, buckets=4)


def test_write_by_folder(spark, tmp_path):
    df = spark.createDataFrame([("a/b/x.jpg",), ("a/y.jpg",), ("z.jpg",)], "file_name string")
    sinks.write_by_folder(df, str(tmp_path / "tree"))
    back = spark.read.parquet(str(tmp_path / "tree")).select("file_name", "dir").collect()
    assert {(r["file_name"], r["dir"] or "") for r in back} == {
        ("a/b/x.jpg", "a/b/"), ("a/y.jpg", "a/"), ("z.jpg", "")
    }


def test_tables(spark, tmp_path):
    classes = tables.class_table(spark, {3: "car", 5: "person"})
    assert {tuple(r) for r in classes.collect()} == {(3, "car"), (5, "person")}
    assert tables.class_table(spark, ["car", "van"]).count() == 2
    frames = spark.createDataFrame([(1, 0, "0.jpg")], "video_id bigint, frame_idx int, frame_name string")
    frames.write.parquet(str(tmp_path / "t"))
    assert tables.read_frames(spark, str(tmp_path / "t")).count() == 1


@pytest.mark.parametrize(
    ("path", "root", "name"),
    [
        ("s3a://bucket/a/x.jpg", "s3a://bucket/", "a/x.jpg"),
        ("s3a://data/data/x.jpg", "s3a://data/data", "x.jpg"),
        ("file:/r/in/b/r/in/c.jpg", "/r/in", "b/r/in/c.jpg"),
        ("file:/r/inner/c.jpg", "/r/in", None),
    ],
)
def test_relative_path(spark, path, root, name):
    df = spark.createDataFrame([(path,)], "path string")
    assert objects.with_relative_path(df, root).first()["file_name"] == name


def test_content_of_missing_and_odd_names(spark, tmp_path):
    (tmp_path / "a[1].jpg").write_bytes(b"abc")
    listing = objects.scan_objects(spark, str(tmp_path))
    gone = listing.withColumn("path", F.concat("path", F.lit("x")))
    rows = objects.load_content(spark, listing.unionByName(gone), str(tmp_path)).collect()
    assert sorted(bytes(r["content"] or b"") for r in rows) == [b"", b"abc"]
