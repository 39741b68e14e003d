import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import geometry as G
from veilframe.functions import labels as L
from veilframe.functions import paths as P
from veilframe.model import Options
from veilframe.operators import detections as D
from veilframe.operators import frames as V
from veilframe.operators import runlog
from veilframe.operators import selection as S
from veilframe.plans import scale
from veilframe.plans import fixtures as X


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr).first()[0]


@pytest.mark.parametrize(
    "name,image,video",
    [
        ("a.JPG", True, False), ("a.jpeg", True, False), ("a.Png", True, False), ("a.gif", False, False),
        ("a.mp4", False, True), ("a.MP4", False, True), ("a.Mp4", False, False), ("a.mov", False, True),
        ("jpg", False, False),
    ],
)
def test_suffixes(spark, name, image, video):
    assert one(spark, name, P.is_image("v")) is image
    assert one(spark, name, P.is_video("v")) is video


def test_exclusion_is_literal_and_case_sensitive(spark):
    assert one(spark, "x/00_UNSORTED/a.jpg", S.not_excluded("v", "00_UNSORTED")) is False
    assert one(spark, "x/00_unsorted/a.jpg", S.not_excluded("v", "00_UNSORTED")) is True
    assert one(spark, "x/00xUNSORTED/a.jpg", S.not_excluded("v", "00_UNSORTED")) is True


def test_recency_is_inclusive_and_needs_a_time(spark):
    now = dt.datetime(2024, 5, 2, 12)
    rows = [(now - dt.timedelta(hours=24),), (now - dt.timedelta(hours=24, seconds=1),), (None,)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    got = df.select(S.recent("t", F.lit(now).cast("timestamp_ntz"), dt.timedelta(hours=24))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_paths(spark):
    assert one(spark, "a/b/c.jpg", P.base_name("v")) == "c.jpg"
    assert one(spark, "x/x/x", P.dir_by_replace("v")) == "//"
    assert one(spark, "x/x/x", P.dir_name("v")) == "x/x/"
    assert one(spark, "a", P.join_path("v", F.lit("b"))) == "a/b"
    assert one(spark, "a/", P.join_path("v", F.lit("b"))) == "a/b"
    assert one(spark, "", P.join_path("v", F.lit("b"))) == "b"
    assert one(spark, "a", P.join_path("v", F.lit("/b"))) == "/b"
    assert one(spark, "/r/in/a/b.mp4", P.relative_path("v", "/r/in/")) == "a/b.mp4"
    assert one(spark, "a.b.jpg", P.blurred_name("v")) == "a_blurred.b_blurred.jpg"


def test_model_size(spark):
    assert tuple(one(spark, "m-v2-960px-best", P.square_size("v"))) == (960, 960)
    with pytest.raises(Exception, match="no pixel size"):
        one(spark, "m-v2", P.square_size("v"))


def test_stem_numbers(spark):
    assert one(spark, "12.x.jpg", P.stem_number("v")) == 12
    assert one(spark, "cover.jpg", P.stem_number("v", strict=False)) is None
    with pytest.raises(Exception, match="without a number"):
        one(spark, "cover.jpg", P.stem_number("v"))


def test_scores_round_like_exact_decimals(spark):
    rng = random.Random(3)
    values = [2.675, 0.125, 0.375, 0.145, 1.005, 0.285, 0.0, -0.125, -2.675, 99.995]
    values += [rng.random() * 10 for _ in range(500)] + [i / 200 for i in range(400)] + [i / 1000 for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", G.round_score("v").alias("r")).collect():
        assert r["r"] == round(r["v"], 2), r["v"]


def test_corners_truncate_toward_zero(spark):
    df = spark.createDataFrame([(-1.9, 1.9, -0.5, 2.0)], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(df.select(*G.int_corners()).first()) == (-1, 1, 0, 2)


def test_labels(spark):
    assert one(spark, "car", L.label_text("v", F.lit(0.5))) == "car 0.5"
    m = F.create_map(F.lit("a"), F.lit(0.3))
    assert one(spark, "a", L.lookup(m, F.col("v"), 0.15)) == 0.3
    assert one(spark, "b", L.lookup(m, F.col("v"), 0.15)) == 0.15


def classes(spark):
    return spark.createDataFrame([(0, "car"), (1, "person")], "class_id int, class_name string")


def boxes(spark):
    rows = [(1, 1, 0, 0.9, 0.0, 0.0, 4.0, 4.0), (1, 2, 1, math.nan, 0.0, 0.0, 4.2, 0.9), (2, 1, 7, 0.1, 1.0, 1.0, 2.0, 2.0)]
    return spark.createDataFrame(
        rows, "image_id bigint, det_id int, class_id int, score double, x0 double, y0 double, x1 double, y1 double"
    )


def test_confidence_drops_nan(spark):
    assert [r["det_id"] for r in boxes(spark).where(D.confident(0.15)).collect()] == [1]


def test_unknown_class(spark):
    assert D.name_classes(boxes(spark), classes(spark)).count() == 2
    with pytest.raises(Exception, match="unknown class id 7"):
        D.name_classes(boxes(spark), classes(spark), strict=True).collect()


def test_empty_boxes(spark):
    assert D.valid_boxes(boxes(spark)).count() == 2
    assert [r["det_id"] for r in D.rejected_boxes(boxes(spark)).collect()] == [2]
    with pytest.raises(Exception, match="empty box on image 1"):
        D.valid_boxes(boxes(spark), strict=True).collect()


def test_class_lists(spark):
    df = spark.createDataFrame([(["car", "van", "car"],)], "names array<string>")
    listed = D.classes_from_list(df, "names")
    assert [tuple(r) for r in listed.collect()] == [(0, "car"), (1, "van"), (2, "car")]
    assert {tuple(r) for r in D.class_ids(listed).collect()} == {("car", 2), ("van", 1)}


def test_images_with_and_without_boxes(spark):
    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "image_id bigint, name string")
    inner = D.images_with_boxes(images, boxes(spark), keep_empty=False)
    left = D.images_with_boxes(images, boxes(spark), keep_empty=True)
    assert sorted(r["name"] for r in inner.collect()) == ["a", "a", "b"]
    assert sorted(r["name"] for r in left.collect()) == ["a", "a", "b", "c"]


def test_summary_of_nothing(spark):
    log = spark.createDataFrame([], "blurred boolean, blurred_objects int")
    assert tuple(runlog.run_summary(spark.range(0), log).first()) == (0, 0, 0)


def test_options_refuse_a_fractional_kernel():
    for kernel in (0.7, 0, True, -3):
        with pytest.raises(ValueError):
            Options(blur_classes=("a",), min_altitude=1.0, kernel=kernel)


def test_numbering_with_a_hot_group(spark, sf):
    events = X.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("video_id"), "ts", "event_id"
    )
    plain = V.number_frames(events, ["ts", "event_id"])
    split = V.number_frames(events, ["ts", "event_id"], hot_rows=20)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))
    assert dict(plain.dtypes) == dict(split.dtypes)


def test_numbering_with_null_keys_and_falling_order(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 9)], "image_id bigint, v int")
    for limit in (1, 100):
        got = scale.numbered(df, ["image_id"], [F.col("v").desc()], "n", start=1, hot_rows=limit)
        assert {tuple(r) for r in got.collect()} == {(None, 1, 2), (None, 2, 1), (5, 3, 2), (5, 9, 1)}


def test_positions_are_global(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"))
    got = scale.positioned(df, ["v"], "place")
    assert got.where("place != v").count() == 0
    assert got.count() == 5000


def test_hot_keys_are_a_table_when_many(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 100).alias("k"))
    assert scale.hot_keys(df, ["k"], 3) is None
    assert scale.hot_keys(df, ["k"], 2).count() == 100
    monkeypatch.setattr(scale, "SMALL_ROWS", 5)
    assert scale.hot_keys(df, ["k"], 2).count() == 100


def test_large_side_is_not_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(scale.small(spark.range(10))).lower()
    assert "broadcast" not in plan(scale.small(spark.range(10), max_rows=5)).lower()


def frames(spark):
    names = ["10.jpg", "9.jpg", "0.jpg", "2.jpg"]
    rows = [(v, n, i, 4 if n == "0.jpg" else 5, 6) for v in (1, 2) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "video_id bigint, frame_name string, event_id int, width int, height int")


def test_frames_are_ordered_by_number(spark):
    got = V.order_frames(frames(spark)).where("video_id = 1").orderBy("place")
    assert [r["frame_name"] for r in got.collect()] == ["0.jpg", "2.jpg", "9.jpg", "10.jpg"]
    assert sorted(r["frame_name"] for r in V.first_frames(frames(spark), 2).where("video_id = 2").collect()) == ["0.jpg", "2.jpg"]
    assert V.first_frames(frames(spark), None).count() == 8
    one_video = frames(spark).where("video_id = 1")
    assert [r["frame_name"] for r in V.first_frames_of_one(one_video, 3).collect()] == ["0.jpg", "2.jpg", "9.jpg"]
    assert V.first_frames_of_one(one_video, None).count() == 4


def test_manifest(spark):
    videos = spark.createDataFrame([(1, "cam/a.mp4"), (2, "b.mp4")], "video_id bigint, video_path string")
    rows = V.manifest(frames(spark), videos, "out").orderBy("video_id", "place").collect()
    assert [r["frame_name"] for r in rows[:4]] == ["0.jpg", "2.jpg", "9.jpg", "10.jpg"]
    assert [r["fits"] for r in rows[:4]] == [True, False, False, False]
    assert rows[0]["output_path"] == "out/cam/a.mp4" and rows[4]["output_path"] == "out/b.mp4"
    assert [r["seconds"] for r in rows[:4]] == [0.0, 1 / 24, 2 / 24, 3 / 24]


def test_first_frames_limit_before_the_shuffle(spark):
    plan = V.first_frames(frames(spark), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_candidates_filter_before_the_join(spark, sf):
    now = F.to_timestamp_ntz(F.lit("1998-08-01 00:00:00"))
    chosen = S.candidates(X.v_objects(spark, sf), X.v_log(spark, sf), now)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "PushedFilters: [IsNotNull(o_orderdate)" in plan
