import math
import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import overlap
from veilframe.plans import fixtures as X


def conflict(a, b, iou):
    w = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])
    h = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    inter = max(w, 0) * max(h, 0)
    size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return inter > iou * (size(a) + size(b) - inter)


def boxes_of(n, seed, spread=60.0, copies=True):
    """One crowded image: random boxes, jittered copies, exact copies, empty boxes."""
    rng, out = random.Random(seed), []
    centres = [(rng.uniform(0, spread), rng.uniform(0, spread)) for _ in range(max(1, n // 12))]
    for i in range(n):
        cx, cy = rng.choice(centres)
        w, h = rng.choice([0.5, 3, 8, 20]) * rng.uniform(0.7, 1.4), rng.choice([1, 6, 15]) * rng.uniform(0.7, 1.4)
        x, y = cx + rng.gauss(0, 0.15 * w), cy + rng.gauss(0, 0.15 * h)
        if copies and i % 7 == 0 and out:
            last = rng.choice(out)
            x, y, w, h = last["x0"], last["y0"], last["x1"] - last["x0"], last["y1"] - last["y0"]
        if i % 23 == 0:
            h = 0.0
        out.append(
            dict(image_id=1, class_id=i % 2, det_id=i + 1, score=round(rng.random(), 2),
                 x0=x, y0=y, x1=x + w, y1=y + h)
        )
    return out


def plain_nms(rows, conf, iou):
    kept = []
    for r in sorted((r for r in rows if r["score"] >= conf), key=lambda r: (-r["score"], r["det_id"])):
        if not any(k["class_id"] == r["class_id"] and conflict(k, r, iou) for k in kept):
            kept.append(r)
    return sorted(r["det_id"] for r in kept)


SCHEMA = (
    "image_id bigint, class_id int, det_id int, score double, x0 double, y0 double, x1 double, y1 double"
)


def frame(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


@pytest.mark.parametrize("iou,fold_limit", [(0.1, 5), (0.4, 5), (0.4, 30), (0.9, 5)])
def test_nms_folded_and_in_rounds_equal_the_plain_loop(spark, iou, fold_limit):
    rows = boxes_of(120, seed=int(iou * 10))
    want = plain_nms(rows, 0.15, iou)
    df = frame(spark, rows)
    folded = sorted(r[0] for r in overlap.nms(df, 0.15, iou).select("det_id").collect())
    rounds = sorted(r[0] for r in overlap.nms(df, 0.15, iou, fold_limit=fold_limit).select("det_id").collect())
    assert folded == want
    assert rounds == want


def test_nms_rounds_on_copies_of_one_box(spark):
    rows = [
        dict(image_id=1, class_id=0, det_id=i, score=0.5, x0=1.0, y0=1.0, x1=9.0, y1=9.0)
        for i in range(1, 400)
    ]
    kept = overlap.nms(frame(spark, rows), 0.15, 0.9, fold_limit=10).collect()
    assert [r["det_id"] for r in kept] == [1]


def test_nms_is_idempotent(spark, sf):
    once = overlap.nms(X.v_detections(spark, sf), 0.15, 0.4)
    twice = overlap.nms(once, 0.15, 0.4)
    assert once.count() == twice.count() == 4971


def test_nms_drops_nan_and_keeps_all_at_one(spark):
    rows = [
        dict(image_id=1, class_id=0, det_id=i, score=s, x0=0.0, y0=0.0, x1=2.0, y1=2.0)
        for i, s in enumerate([0.9, math.nan, 0.9])
    ]
    assert overlap.nms(frame(spark, rows), 0.15, 1.0).count() == 2
    assert overlap.nms(frame(spark, rows), 0.15, 0.5).count() == 1


@pytest.mark.parametrize("iou", [0.2, 0.4, 0.9])
def test_pairs_by_group_and_by_cell_equal_brute_force(spark, iou):
    rows = boxes_of(160, seed=5)
    df = frame(spark, rows)
    total = sum(
        conflict(a, b, iou)
        for i, a in enumerate(rows)
        for b in rows[i + 1 :]
        if a["class_id"] == b["class_id"] and a["y1"] > a["y0"] and b["y1"] > b["y0"]
    )
    columns = ["class_id", "det_a", "det_b", "iou", "pairs"]
    grouped = sorted(map(tuple, overlap.iou_pairs(df, iou).select(*columns).collect()))
    celled = sorted(map(tuple, overlap.iou_pairs(df, iou, pair_limit=1).select(*columns).collect()))
    assert grouped == celled
    assert sum(r[-1] for r in grouped) == total


def test_iou_out_of_range_is_refused(spark):
    with pytest.raises(ValueError):
        overlap.nms(frame(spark, boxes_of(3, 1)), 0.1, 0.0)


def test_cell_paths_on_given_boxes(spark, sf):
    boxes = X.v_detections(spark, sf).withColumn("image_id", F.lit(7).cast("bigint"))
    boxes = boxes.withColumn("det_id", F.xxhash64("det_id", "x0", "y0", "score", "x1")).distinct()
    folded = overlap.nms(boxes, 0.15, 0.4, fold_limit=10**9).select("class_id", "det_id")
    rounds = overlap.nms(boxes, 0.15, 0.4, fold_limit=100).select("class_id", "det_id")
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, rounds.collect()))
