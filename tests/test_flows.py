import datetime as dt
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.model import LOG_SCHEMA, Options
from veilframe.operators import raster
from veilframe.operators.scoring import score
from veilframe.plans.flows import choose_work, image_log, image_run, video_run
from veilframe.sources import logs
from veilframe.streaming import ingest

from tests.model_numpy import redact as plain_redact
from tests.test_raster import pack, unpack

NOW = dt.datetime(2024, 6, 1, 12)
OPTIONS = Options(blur_classes=("person",), min_altitude=100.0, kernel=3, iou=0.5, n_frames=2)


def classes(spark):
    return spark.createDataFrame([(0, "car"), (1, "person")], "class_id int, class_name string")


def objects(spark):
    rows = [
        (1, "a/1.jpg", NOW - timedelta(hours=1), 5000, 50.0),
        (2, "a/2.jpg", NOW - timedelta(hours=2), 5000, 500.0),
        (3, "a/3.png", NOW - timedelta(hours=3), 100, 50.0),
        (4, "a/4.jpg", NOW - timedelta(hours=3), 5000, None),
        (5, "a/5.jpg", NOW - timedelta(hours=30), 5000, 50.0),
        (6, "00_UNSORTED/6.jpg", NOW, 5000, 50.0),
        (7, "a/7.txt", NOW, 5000, 50.0),
        (8, "a/8.jpg", NOW, 5000, 50.0),
        (9, "a/9.jpg", NOW, 5000, 99.0),
    ]
    return spark.createDataFrame(
        rows, "image_id bigint, file_name string, last_modified timestamp, length bigint, altitude double"
    )


def empty_log(spark):
    return spark.createDataFrame([], LOG_SCHEMA).select("file_name")


def pictures():
    rng = np.random.default_rng(1)
    return {i: rng.integers(0, 256, (8, 8, 1)) for i in range(1, 10)}


RAW = [
    (1, 1, 1, 0.9, 1.0, 1.0, 6.0, 6.0), (1, 2, 1, 0.8, 1.0, 1.0, 6.0, 5.8), (1, 3, 0, 0.9, 0.0, 0.0, 3.0, 3.0),
    (1, 4, 1, 0.7, 4.0, 4.0, 8.0, 8.0), (2, 1, 1, 0.9, 0.0, 0.0, 4.0, 4.0), (9, 1, 1, 0.05, 0.0, 0.0, 4.0, 4.0),
]


def detector(spark, seen):
    schema = "image_id bigint, det_id int, class_id int, score double, x0 double, y0 double, x1 double, y1 double"

    def detect(lines):
        seen.update(r[0] for r in lines.select("image_id").distinct().collect())
        return spark.createDataFrame(RAW, schema).join(
            lines.select("image_id").distinct(), "image_id", "left_semi"
        )

    return detect


def test_image_run(spark):
    seen, images = set(), pictures()
    log = spark.createDataFrame([("a/8.jpg",)], "file_name string")
    out = image_run(
        objects(spark), log, pack(spark, images), detector(spark, seen), classes(spark), F.lit(NOW), OPTIONS
    )
    assert seen == {1, 9}  # nothing above the gate is scored
    rows = {r["file_name"]: (r["blurred"], r["blurred_objects"]) for r in out["log"].collect()}
    assert rows == {"a/1.jpg": (True, 2), "a/2.jpg": (False, 0), "a/9.jpg": (False, 0)}
    assert dict(out["log"].dtypes) == {
        "file_name": "string", "datetime": "timestamp", "blurred": "boolean", "blurred_objects": "int"
    }
    assert tuple(out["summary"].first()) == (5, 1, 2)
    assert [tuple(r) for r in out["bad"].collect()] == [("a/3.png", "too small")]
    got = unpack(out["redacted"])
    assert set(got) == {1, 9}
    want = plain_redact(
        images[1],
        [dict(det_id=1, x0=1, y0=1, x1=6, y1=6), dict(det_id=4, x0=4, y0=4, x1=8, y1=8)],
        3,
    )
    assert (got[1] == want).all() and (got[9] == images[9]).all()


def test_the_log_counts_the_boxes_that_are_applied(spark):
    """Boxes without a whole pixel, outside the image, or of unknown classes elsewhere."""
    images = pictures()
    boxes = spark.createDataFrame(
        [(1, 1, 1, 0.9, 2.2, 2.0, 2.9, 6.0), (1, 2, 1, 0.9, 20.0, 20.0, 30.0, 30.0), (9, 1, 1, 0.9, 0.0, 0.0, 3.0, 3.0),
         (8, 1, 77, 0.9, 0.0, 0.0, 3.0, 3.0)],
        "image_id bigint, det_id int, class_id int, score double, x0 double, y0 double, x1 double, y1 double",
    )
    log = spark.createDataFrame([("a/8.jpg",)], "file_name string")
    for suppress in (False, True):
        out = image_run(
            objects(spark), log, pack(spark, images), lambda lines: boxes, classes(spark), F.lit(NOW), OPTIONS, suppress
        )
        rows = {r["file_name"]: (r["blurred"], r["blurred_objects"]) for r in out["log"].collect()}
        assert rows == {"a/1.jpg": (False, 0), "a/2.jpg": (False, 0), "a/9.jpg": (True, 1)}
        got = unpack(out["redacted"])
        assert (got[1] == images[1]).all() and not (got[9] == images[9]).all()


@pytest.mark.parametrize("only_with_boxes", [False, True])
def test_video_run(spark, only_with_boxes):
    seen, images = set(), pictures()
    rows = [(1, f"{n}.jpg", i, 8, 8) for n, i in ((10, 3), (0, 1), (1, 2))]
    frames = spark.createDataFrame(
        rows, "video_id bigint, frame_name string, image_id bigint, width int, height int"
    )
    videos = spark.createDataFrame([(1, "v.mp4")], "video_id bigint, video_path string")
    options = Options(blur_classes=("person",), draw_classes=("person", "car"), min_altitude=0.0, kernel=3, n_frames=2)
    detect = detector(spark, seen)
    boxes_on_first = lambda lines: detect(lines).where("image_id = 1")
    out = video_run(
        frames, videos, pack(spark, images), boxes_on_first, classes(spark), "out", options, only_with_boxes
    )
    assert seen == {1, 2}  # frames beyond the limit are never scored
    got = unpack(out["redacted"])
    names = [r["frame_name"] for r in out["manifest"].orderBy("place").collect()]
    assert names == (["0.jpg"] if only_with_boxes else ["0.jpg", "1.jpg"])
    assert set(got) == ({1} if only_with_boxes else {1, 2})
    boxes = [
        dict(det_id=d, x0=int(x0), y0=int(y0), x1=int(x1), y1=int(y1), draw=True, blur=c == 1)
        for i, d, c, s, x0, y0, x1, y1 in RAW if i == 1
    ]
    assert (got[1] == plain_redact(images[1], boxes, 3)).all()


def test_scoring_only_below_the_gate(spark, tmp_path):
    marks = str(tmp_path)

    def make():
        def predict(batch):
            import pathlib

            with open(pathlib.Path(marks) / "seen", "a") as out:
                out.write("x" * len(batch))
            rows = len(batch)
            fill = lambda v, t: np.full((rows, 1), v, dtype=t)
            return {
                "class_id": fill(1, "int32"), "x0": fill(0.0, "float64"), "y0": fill(0.0, "float64"),
                "x1": fill(2.0, "float64"), "y1": fill(2.0, "float64"),
                "score": batch.mean(axis=1, keepdims=True).astype("float64"),
            }

        return predict

    scan = pack(spark, pictures())
    work = choose_work(objects(spark), empty_log(spark), F.lit(NOW), OPTIONS)
    lines = scan.join(work.redact.select("image_id"), "image_id", "left_semi")
    boxes = score(raster.to_tensor(lines), make, [64]).collect()
    assert sorted(r["image_id"] for r in boxes) == [1, 8, 9]
    assert (tmp_path / "seen").read_text() == "xxx"


def test_stream_restart_adds_nothing(spark, tmp_path):
    source = tmp_path / "in"
    objects(spark).drop("last_modified").write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema

    def run():
        new = ingest.stream_table(spark, str(source), schema)
        ingest.ingest(new, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 9
    assert run() == 9
    objects(spark).drop("last_modified").limit(2).write.mode("append").parquet(str(source))
    assert run() == 11


def test_object_stream(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x.jpg").write_bytes(b"12345")
    listed = ingest.stream_objects(spark, str(tmp_path / "in")).select("path", "length")
    ingest.ingest(listed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["length"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [5]


def test_batches_share_the_log_and_repeat_safely(spark, tmp_path):
    source, log_path = str(tmp_path / "in"), str(tmp_path / "log")
    schema = objects(spark).schema
    detect = detector(spark, set())

    def work(batch, log):
        chosen = choose_work(batch, log, F.lit(NOW), OPTIONS)
        return image_log(chosen, detect(pack(spark, pictures())), classes(spark), F.lit(NOW), OPTIONS)

    def run(state):
        new = ingest.stream_table(spark, source, schema)
        ingest.logged_batches(new, work, log_path, str(tmp_path / state)).awaitTermination()
        rows = logs.read_log_path(spark, log_path).collect()
        return sorted((r["file_name"], r["blurred_objects"]) for r in rows)

    objects(spark).write.parquet(source)
    first = run("state")
    assert first == [("a/1.jpg", 2), ("a/2.jpg", 0), ("a/8.jpg", 0), ("a/9.jpg", 0)]
    assert run("state") == first
    objects(spark).write.mode("append").parquet(source)  # the same objects arrive again
    assert run("state") == first
    # a lost stream state repeats batch 0, which writes the same rows to the same place
    assert run("other") == first


def test_first_seen_drops_repeats_across_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    df = objects(spark).select("file_name", "last_modified")
    df.write.parquet(source)

    def run():
        new = ingest.stream_table(spark, source, df.schema)
        once = ingest.first_seen(new, "file_name", "last_modified")
        ingest.ingest(once, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    first = run()
    df.where(F.col("last_modified") >= F.lit(NOW - timedelta(hours=3))).write.mode("append").parquet(source)
    assert (first, run()) == (9, 9)
