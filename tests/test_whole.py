"""Images that fit one task: the same pixels as wave by wave, with repeated lines, and in one shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import raster, waves, whole

from tests.model_numpy import redact as plain_redact
from tests.test_raster import boxes_df, pack, unpack


def pictures_and_boxes(seed=2):
    rng = np.random.default_rng(seed)
    pictures = {i: rng.integers(0, 256, (int(rng.integers(1, 14)), int(rng.integers(1, 14)), [1, 3][i % 2])) for i in range(1, 30)}
    rows = []
    for det in range(150):
        x, y = (int(v) for v in rng.integers(-4, 13, 2))
        rows.append(dict(image_id=int(rng.integers(1, 33)), det_id=det, x0=x, y0=y, x1=x + int(rng.integers(0, 9)), y1=y + int(rng.integers(0, 9)),
                         draw=bool(det % 3 == 0), blur=bool(det % 4)))
    return pictures, rows


@pytest.mark.parametrize("k", [4])
def test_whole_images_equal_waves(spark, k):
    pictures, rows = pictures_and_boxes()
    scan, boxes = pack(spark, pictures), boxes_df(spark, rows)
    want = unpack(waves.redacted_by_waves(scan, boxes.where("draw or blur"), k, 512, False))
    for limit in (512, 4):  # with 4, some images go wave by wave
        got = unpack(waves.redact(scan, boxes, k, fold_limit=limit))
        assert got.keys() == want.keys() == pictures.keys()
        assert all((got[i] == want[i]).all() for i in want)


def test_whole_images_equal_plain_code(spark):
    pictures, rows = pictures_and_boxes(5)
    rows = [{**r, "draw": False, "blur": True} for r in rows]
    got = unpack(waves.redact(pack(spark, pictures), boxes_df(spark, rows), 5))
    for i, picture in pictures.items():
        assert (got[i] == plain_redact(picture, [r for r in rows if r["image_id"] == i], 5)).all()


def test_outlines_of_whole_images(spark):
    pictures, rows = pictures_and_boxes(7)
    rows = [{**r, "x0": max(r["x0"], 0), "y0": max(r["y0"], 0)} for r in rows]
    rows = [{**r, "x1": min(r["x1"], w), "y1": min(r["y1"], h)} for r in rows for h, w in [pictures.get(r["image_id"], np.empty((0, 0))).shape[:2]]]
    scan, boxes = pack(spark, pictures), boxes_df(spark, rows)
    want = unpack(raster.outlined_lines(scan, boxes))
    for limit in (512, 3):
        got = unpack(raster.draw_outlines(scan, boxes, fold_limit=limit))
        assert got.keys() == want.keys() and all((got[i] == want[i]).all() for i in want)


def test_repeated_and_nameless_lines(spark):
    """Lines that come twice are painted alike, as many times as by waves; lines without an image id stay."""
    pictures, rows = pictures_and_boxes(3)
    scan = pack(spark, pictures)
    nameless = scan.where("image_id = 1").withColumn("image_id", F.lit(None).cast("long"))
    scan, boxes = scan.unionByName(scan.where("image_id % 2 = 0")).unionByName(nameless), boxes_df(spark, rows)
    key = lambda df: sorted(map(str, df.select(*raster.SCAN).collect()))
    assert key(waves.redact(scan, boxes, 4)) == key(waves.redacted_by_waves(scan, boxes.where("draw or blur"), 4, 512, False))


def test_outlines_over_null_values(spark):
    pictures, rows = pictures_and_boxes(4)
    rows = [{**r, "x0": 0, "y0": 0, "x1": 1, "y1": 1} for r in rows]
    scan = pack(spark, pictures).withColumn("vals", F.expr("transform(vals, (v, x) -> if(image_id % 3 = 0 or x = 2, null, v))"))
    scan = scan.unionByName(scan.where("image_id % 4 = 0"))
    boxes, key = boxes_df(spark, rows), lambda df: sorted(map(str, df.select(*raster.SCAN).collect()))
    assert key(raster.draw_outlines(scan, boxes)) == key(raster.outlined_lines(scan, boxes))


def test_many_touched_images_are_moved_once(spark, tmp_path, monkeypatch):
    """With more ids than can be broadcast, lines meet boxes by one shuffle and no join."""
    monkeypatch.setattr(whole, "SMALL_IDS", 2)
    pictures, rows = pictures_and_boxes()
    pack(spark, pictures).write.parquet(str(tmp_path / "scan"))
    scan = spark.read.parquet(str(tmp_path / "scan"))
    done = waves.redact(scan, boxes_df(spark, rows), 3)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    want = unpack(waves.redacted_by_waves(scan, boxes_df(spark, rows).where("draw or blur"), 3, 512, False))
    got = unpack(done)
    assert all((got[i] == want[i]).all() for i in want)


def test_images_are_cut_between_batches(spark):
    """A batch of rows ends within an image."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pictures, rows = pictures_and_boxes(9)
    rows = [{**r, "draw": False, "blur": True} for r in rows]
    whole_bytes = whole.BYTES
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        whole.BYTES = 1
        got = unpack(waves.redact(pack(spark, pictures), boxes_df(spark, rows), 3))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        whole.BYTES = whole_bytes
    for i, picture in pictures.items():
        assert (got[i] == plain_redact(picture, [r for r in rows if r["image_id"] == i], 3)).all()
