"""Work on hot groups: waves by strips, tiles, united runs, ranks, partners and written tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import overlap, raster, waves
from veilframe.plans import scale

from tests.model_numpy import mean_of
from tests.test_raster import boxes_df, images, pack, unpack


def plain_waves(rows):
    """Waves by a grid of all edges."""
    xs, ys = ({v: i for i, v in enumerate(sorted({r[e] for r in rows for e in ends}))} for ends in (("x0", "x1"), ("y0", "y1")))
    grid, out = np.full((len(ys), len(xs)), -1), {}
    for r in sorted(rows, key=lambda r: r["det_id"]):
        some = grid[ys[r["y0"]] : ys[r["y1"]], xs[r["x0"]] : xs[r["x1"]]]
        out[r["det_id"]] = int(some.max()) + 1
        some[:] = out[r["det_id"]]
    return out


def test_waves_of_many_large_boxes(spark):
    """Boxes of a million pixels each on one image; another image is folded, and so is none at all."""
    rng = np.random.default_rng(4)
    rows = []
    for det, (x, y) in enumerate(rng.integers(0, 3000, (700, 2))):
        rows.append(dict(image_id=1, det_id=det, x0=int(x), y0=int(y), x1=int(x) + 1000, y1=int(y) + 1000))
    rows += [dict(image_id=2, det_id=d, x0=d, y0=0, x1=d + 2, y1=5) for d in range(20)]
    got = waves.blur_waves(boxes_df(spark, rows), fold_limit=250).collect()
    for image in (1, 2):
        own = [r for r in rows if r["image_id"] == image]
        assert {r["det_id"]: r["wave"] for r in got if r["image_id"] == image} == plain_waves(own)


def test_waves_of_boxes_without_an_image_id(spark):
    rows = [dict(image_id=None, det_id=d, x0=0, y0=d % 3, x1=4, y1=d % 3 + 2) for d in range(30)]
    got = waves.blur_waves(boxes_df(spark, rows), fold_limit=7).collect()
    assert {r["det_id"]: r["wave"] for r in got} == plain_waves(rows)


@pytest.mark.parametrize("k", [1, 2, 3, 8, 25])
def test_tiles_equal_the_whole_box(spark, k):
    """Tiles smaller than the kernel, boxes of one line or column, and kernels larger than a box."""
    pictures = images(2)
    rows = [dict(image_id=1, det_id=1, x0=1, y0=0, x1=13, y1=9), dict(image_id=3, det_id=1, x0=0, y0=0, x1=7, y1=1),
            dict(image_id=4, det_id=1, x0=0, y0=2, x1=1, y1=11), dict(image_id=5, det_id=1, x0=3, y0=3, x1=5, y1=8)]
    scan = pack(spark, pictures)
    for tile in (2, 5):
        segments = raster.blur_segments(scan, boxes_df(spark, rows), k, tile)
        got = unpack(raster.paint(scan, segments))
        for r in rows:
            want = pictures[r["image_id"]].copy()
            for c in range(want.shape[2]):
                want[r["y0"] : r["y1"], r["x0"] : r["x1"], c] = mean_of(want[r["y0"] : r["y1"], r["x0"] : r["x1"], c], k)
            assert (got[r["image_id"]] == want).all(), (r, tile)


def test_blur_moves_pixels_as_lines(spark):
    """No pixel is a row, and between the join with boxes and the result there is one more exchange of lines."""
    boxes = boxes_df(spark, [dict(image_id=1, det_id=1, x0=0, y0=0, x1=9, y1=9)])
    segments = raster.blur_segments(pack(spark, images()), boxes, 5)
    plan = segments._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert plan.count("hashpartitioning(image_id") <= 3


def test_redaction_leaves_other_images_in_place(spark, tmp_path):
    """Images without a box meet a broadcast list of ids and nothing else."""
    path = str(tmp_path / "scan")
    pack(spark, images()).write.parquet(path)
    scan = spark.read.parquet(path)
    boxes = boxes_df(spark, [dict(image_id=2, det_id=1, x0=0, y0=0, x1=3, y1=3)])
    plan = waves.redact(scan, boxes, 3)._jdf.queryExecution().executedPlan().toString()
    anti = next(part for part in plan.split("Union")[1].split("Project") if "LeftAnti" in part)
    assert "BroadcastHashJoin" in anti


def test_many_boxes_over_one_line(spark):
    """A hundred thousand outlines leave at most half as many runs as the line is wide."""
    width = 400
    rng = np.random.default_rng(0)
    x0 = rng.integers(0, width - 10, 100_000)
    x1 = np.minimum(width, x0 + rng.integers(3, 300, 100_000))
    some = rng.choice(100_000, 40, replace=False)
    every = spark.range(100_000).select(
        F.lit(1).cast("long").alias("image_id"), (F.col("id") % (width - 6)).cast("int").alias("x0"),
        F.lit(0).alias("y0"), (F.col("id") % (width - 6) + 6).cast("int").alias("x1"), F.lit(9).alias("y1"),
    )
    runs = raster.outline_runs(every).where("y = 4").collect()
    assert [(r["x0"], r["n"]) for r in runs] == [(0, width)] or len(runs) <= width // 2
    rows = [dict(image_id=1, det_id=int(i), x0=int(x0[i]), y0=0, x1=int(x1[i]), y1=9) for i in some]
    covered = np.zeros(width + 1, bool)
    for r in rows:
        covered[r["x0"] : r["x0"] + 2] = covered[r["x1"] - 2 : r["x1"]] = True
        if r["x1"] - r["x0"] <= 4:
            covered[r["x0"] : r["x1"]] = True
    got = np.zeros(width + 1, bool)
    runs = sorted((r["x0"], r["n"]) for r in raster.outline_runs(boxes_df(spark, rows)).where("y = 4").collect())
    for a, n in runs:
        got[a : a + n] = True
    assert (got == covered).all()
    assert all(a + n < b for (a, n), (b, _) in zip(runs, runs[1:], strict=False))


def test_only_hot_groups_are_ranged(spark):
    df = spark.range(3000).select((F.col("id") % 100).alias("g"), F.col("id").alias("v"))
    df = df.unionByName(spark.range(900).select(F.lit(7).cast("long").alias("g"), (F.col("id") + 5000).alias("v")))
    seen = []
    real = scale.positioned

    def watched(rows, order, name):
        seen.append({r["g"] for r in rows.select("g").distinct().collect()})
        return real(rows, order, name)

    scale.positioned = watched
    try:
        got = scale.numbered(df, ["g"], ["v"], "n", start=1, hot_rows=500)
    finally:
        scale.positioned = real
    assert seen == [{7}]
    assert "Window" in got._jdf.queryExecution().executedPlan().toString()
    want = scale.numbered(df, ["g"], ["v"], "n", start=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def brute_partners(rows, iou):
    out = []
    for a in rows:
        if a["x1"] <= a["x0"] or a["y1"] <= a["y0"]:
            continue
        found = []
        for b in rows:
            if b["det_id"] == a["det_id"] or b["image_id"] != a["image_id"] or b["x1"] <= b["x0"] or b["y1"] <= b["y0"]:
                continue
            w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
            both = max(w, 0) * max(h, 0)
            union = sum((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in (a, b)) - both
            if both > iou * union:
                found.append((-both / union, b["det_id"]))
        best = min(found, default=(None, None))
        out.append((a["image_id"], a["det_id"], len(found), best[1], None if best[0] is None else -best[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("iou", "block"), [(0.5, 2_048), (0.8, 5), (1.0, 2_048)])
def test_partner_counts(spark, iou, block):
    rng = np.random.default_rng(6)
    rows = []
    for det in range(150):
        image = [None, 1, 2][det % 3]
        x, y = (int(v) for v in rng.integers(0, 14, 2))
        rows.append(dict(image_id=image, det_id=det, class_id=1, x0=x, y0=y, x1=x + int(rng.integers(0, 12)), y1=y + 10))
    rows += [{**rows[i], "det_id": 200 + n} for n, i in enumerate((4, 4, 7, 8))]
    want, columns = brute_partners(rows, iou), ["image_id", "det_id", "partners", "best_id", "best_iou"]
    for limit in (10, 10_000):
        got = overlap.partner_counts(boxes_df(spark, rows), iou, block, limit).select(*columns)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_partners_of_many_jittered_copies(spark):
    """One group of copies that differ by a pixel or two: a row per box, and no pair leaves a task."""
    n = 20_000
    jitter = spark.range(n).select(
        F.lit(1).cast("long").alias("image_id"), F.lit(1).alias("class_id"), F.col("id").cast("int").alias("det_id"),
        (F.col("id") % 150).cast("double").alias("x0"), (F.col("id") / n).alias("y0"),
        (F.col("id") % 150 + 1000).cast("double").alias("x1"), (F.col("id") / n + 1000).alias("y1"),
    )
    got = overlap.partner_counts(jitter, 0.7).agg(F.count(F.lit(1)), F.min("partners"), F.max("partners")).first()
    assert tuple(got) == (n, n - 1, n - 1)


def test_scopes_leave_the_result_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scale, "shared_dir", lambda _: str(tmp_path))

    @scale.tidy
    def inner():
        kept, other = scale.written(spark.range(5)), scale.written(spark.range(7))
        return kept.join(scale.written(other).limit(0), "id", "left_anti"), {"a": [other.count()]}

    with scale.scratch() as run:
        df, _ = inner()
        more = scale.written(spark.range(3))
        assert len(list(tmp_path.glob("step-*"))) == 2
        run.drop(more)
        assert len(list(tmp_path.glob("step-*"))) == 1
        run.keep(df)
    assert df.count() == 5
    scale.release(df)
    assert not list(tmp_path.glob("step-*"))
    with pytest.raises(ZeroDivisionError), scale.scratch():
        scale.written(spark.range(3))
        1 / 0  # noqa: B018
    assert not list(tmp_path.glob("step-*"))


def test_one_image_is_resampled_on_several_tasks(spark):
    """Without broadcasts, the lines of one image are stretched and mixed in several partitions."""
    rng = np.random.default_rng(1)
    scan = pack(spark, {1: rng.integers(0, 256, (300, 12, 1))})
    sizes = spark.createDataFrame([(1, 9, 260)], "image_id bigint, new_width int, new_height int")
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        done = raster.resample(scan, sizes)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "hashpartitioning(image_id" in plan and "_salt" in plan
        parts = done.select("y", F.spark_partition_id().alias("p")).collect()
        sized = raster._with_sizes(scan, sizes).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["y"] for r in parts) == list(range(260))
    assert len({r["p"] for r in parts}) >= 3 and sized >= 3
    whole = unpack(raster.resample(scan, sizes, band=10_000))[1]
    assert (unpack(done)[1] == whole).all() and (unpack(raster.resample(scan, sizes, band=7))[1] == whole).all()


def test_tensor_of_a_large_image_is_refused(spark):
    scan = pack(spark, {1: np.zeros((9, 9, 3), int), 2: np.zeros((3, 3, 3), int)})
    assert raster.to_tensor(scan.where("image_id = 2"), most=27).count() == 1
    with pytest.raises(Exception, match="letterbox it first"):
        raster.to_tensor(scan, most=27).collect()


def test_written_tables_leave_no_shuffle_files(spark):
    """What was shuffled for a table is deleted at once, not when the driver collects its garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    listed = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    files = lambda: {name for f in listed(disk.getAllFiles()) if (name := f.getName()).startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    with scale.scratch():
        made = scale.written(spark.range(1000).repartition(7).groupBy((F.col("id") % 11).alias("k")).count())
        assert len(made.collect()) == 11
        until = time.time() + 10
        while (left := files() - before) and time.time() < until:
            time.sleep(0.2)
    assert spark.conf.get(key) == setting
    assert not left
