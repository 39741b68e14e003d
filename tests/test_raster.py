import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.functions.geometry import letterbox, unletterbox
from veilframe.operators import raster, waves

from tests.model_numpy import redact as plain_redact


def pack(spark, images):
    rows = [
        (i, im.shape[1], im.shape[0], im.shape[2], [int(v) for v in im.reshape(-1)])
        for i, im in images.items()
    ]
    schema = "image_id bigint, width int, height int, channels int, pixels array<int>"
    return raster.scanlines(spark.createDataFrame(rows, schema))


def unpack(scan):
    out = {}
    for r in scan.collect():
        image = out.setdefault(r["image_id"], {})
        image[(r["c"], r["y"])] = r["vals"]
    return {
        i: np.stack(
            [
                np.array([lines[(c, y)] for y in range(1 + max(y for _, y in lines))])
                for c in range(1 + max(c for c, _ in lines))
            ],
            axis=2,
        )
        for i, lines in out.items()
    }


def images(seed=0):
    rng = np.random.default_rng(seed)
    shapes = {1: (9, 13, 3), 2: (6, 6, 1), 3: (1, 7, 1), 4: (11, 1, 1), 5: (8, 8, 3)}
    return {i: rng.integers(0, 256, s) for i, s in shapes.items()}


def box_rows(seed, per_image, with_flags):
    rng = np.random.default_rng(seed)
    out = []
    for i in (1, 2, 3, 4):
        for det in range(per_image):
            x0, y0 = int(rng.integers(-3, 9)), int(rng.integers(-3, 7))
            out.append(
                dict(image_id=i, det_id=det, x0=x0, y0=y0, x1=x0 + int(rng.integers(0, 8)),
                     y1=y0 + int(rng.integers(0, 8)))
            )
            if with_flags:
                out[-1].update(draw=bool(rng.integers(2)), blur=bool(rng.integers(2)))
    return out


def boxes_df(spark, rows):
    names = list(rows[0])
    types = {"image_id": "bigint", "draw": "boolean", "blur": "boolean"}
    schema = ", ".join(f"{n} {types.get(n, 'int')}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@pytest.mark.parametrize("k", [1, 2, 5, 30])
def test_redact_equals_one_box_at_a_time(spark, k):
    pictures, rows = images(), box_rows(k, 5, with_flags=False)
    got = unpack(waves.redact(pack(spark, pictures), boxes_df(spark, rows), k))
    for i, picture in pictures.items():
        want = plain_redact(picture, [r for r in rows if r["image_id"] == i], k)
        assert (got[i] == want).all(), i


def test_redact_draws_before_it_blurs(spark):
    pictures, rows = images(3), box_rows(11, 5, with_flags=True)
    got = unpack(waves.redact(pack(spark, pictures), boxes_df(spark, rows), 3))
    for i, picture in pictures.items():
        want = plain_redact(picture, [r for r in rows if r["image_id"] == i], 3)
        assert (got[i] == want).all(), i


def test_redact_with_peeled_waves(spark):
    pictures, rows = images(5), box_rows(17, 8, with_flags=False)
    got = unpack(waves.redact(pack(spark, pictures), boxes_df(spark, rows), 4, fold_limit=2))
    for i, picture in pictures.items():
        want = plain_redact(picture, [r for r in rows if r["image_id"] == i], 4)
        assert (got[i] == want).all(), i


def test_waves_folded_and_peeled_agree(spark):
    df = boxes_df(spark, box_rows(23, 12, with_flags=False))
    columns = ["image_id", "det_id", "wave"]
    folded = sorted(map(tuple, waves.blur_waves(df).select(*columns).collect()))
    peeled = sorted(map(tuple, waves.blur_waves(df, fold_limit=1).select(*columns).collect()))
    assert folded == peeled
    assert max(w for _, _, w in folded) >= 2


def test_no_boxes_change_nothing(spark):
    pictures = images(7)
    none = boxes_df(spark, box_rows(1, 1, with_flags=False)).limit(0)
    got = unpack(waves.redact(pack(spark, pictures), none, 5))
    for i, picture in pictures.items():
        assert (got[i] == picture).all()


def test_pixels_outside_boxes_stay(spark):
    pictures = images(9)
    rows = [dict(image_id=1, det_id=1, x0=2, y0=1, x1=6, y1=5)]
    got = unpack(waves.redact(pack(spark, pictures), boxes_df(spark, rows), 5))[1]
    outside = np.ones(got.shape[:2], dtype=bool)
    outside[1:5, 2:6] = False
    assert (got[outside] == pictures[1][outside]).all()


def test_pad_and_sizes(spark):
    pictures = images(2)
    border = [F.lit(n) for n in (1, 2, 3, 0)]
    padded = raster.pad(pack(spark, pictures), *border, fill=9)
    got = unpack(padded)
    for i, p in pictures.items():
        want = np.pad(p, ((1, 2), (3, 0), (0, 0)), constant_values=9)
        assert (got[i] == want).all()
    sizes = {r["image_id"]: (r["height"], r["width"]) for r in raster.image_sizes(padded).collect()}
    assert sizes[1] == (12, 16)


def plain_resample(plane, height, width):
    def taps(n_out, n_in):
        s = np.maximum(0.0, (np.arange(n_out) + 0.5) * n_in / n_out - 0.5)
        low = np.floor(s).astype(int)
        return low, np.minimum(low + 1, n_in - 1), s - low

    ya, yb, fy = taps(height, plane.shape[0])
    xa, xb, fx = taps(width, plane.shape[1])
    rows = lambda ys: (1 - fx) * plane[ys][:, xa] + fx * plane[ys][:, xb]
    return (1 - fy)[:, None] * rows(ya) + fy[:, None] * rows(yb)


@pytest.mark.parametrize("height,width", [(12, 12), (3, 5), (1, 1), (6, 6), (23, 4), (8, 2)])
def test_resample(spark, height, width):
    pictures = images(4)
    sizes = spark.createDataFrame(
        [(i, width, height) for i in pictures], "image_id bigint, new_width int, new_height int"
    )
    got = unpack(raster.resample(pack(spark, pictures), sizes, whole=False))
    for i, p in pictures.items():
        for c in range(p.shape[2]):
            want = plain_resample(p[:, :, c].astype(float), height, width)
            assert np.allclose(got[i][:, :, c], want, atol=1e-9), (i, c)


def test_channels_and_tensor(spark):
    pictures = {1: images(6)[1], 5: images(6)[5]}
    scan = pack(spark, pictures)
    swapped = unpack(raster.swap_channels(scan))
    tensors = {r["image_id"]: r for r in raster.to_tensor(scan).collect()}
    for i, p in pictures.items():
        assert (swapped[i] == p[:, :, ::-1]).all()
        want = p.transpose(2, 0, 1).astype(np.float32) / np.float32(255)
        assert tensors[i]["shape"] == [1, 3, p.shape[0], p.shape[1]]
        assert (np.array(tensors[i]["tensor"], dtype=np.float32) == want.reshape(-1)).all()


@pytest.mark.parametrize("auto,scaleup", [(False, True), (True, True), (False, False)])
def test_letterbox_and_back(spark, auto, scaleup):
    sizes = [(w, h) for w in (320, 641, 1919, 960) for h in (240, 999, 1080, 33)]
    df = spark.createDataFrame(sizes, "width int, height int")
    df = df.withColumn("b", letterbox("width", "height", 960, 960, auto, scaleup))
    for r in df.collect():
        ratio = min(960 / r["height"], 960 / r["width"])
        ratio = ratio if scaleup else min(ratio, 1.0)
        inner = (round(r["width"] * ratio), round(r["height"] * ratio))
        dw, dh = 960 - inner[0], 960 - inner[1]
        if auto:
            dw, dh = dw % 32, dh % 32
        dw, dh = dw / 2, dh / 2
        b = r["b"]
        assert (b["ratio"], b["inner_width"], b["inner_height"], b["dw"], b["dh"]) == (ratio, *inner, dw, dh)
        assert (b["top"], b["bottom"]) == (round(dh - 0.1), round(dh + 0.1))
        assert (b["left"], b["right"]) == (round(dw - 0.1), round(dw + 0.1))
    there = df.select(
        "b",
        *[(F.lit(v) * F.col("b.ratio") + F.col(p)).alias(c)
          for c, v, p in (("x0", 10, "b.dw"), ("y0", 5, "b.dh"), ("x1", 200, "b.dw"), ("y1", 30, "b.dh"))],
    )
    back = there.select(*unletterbox(F.col("b.ratio"), F.col("b.dw"), F.col("b.dh")))
    for r in back.collect():
        assert all(abs(a - b) <= 1 for a, b in zip(r, (10, 5, 200, 30)))


def test_scanlines_explode_without_pixels(spark):
    rows = [(1, 400, 300, 3, [i % 251 for i in range(400 * 300 * 3)])]
    schema = "image_id long, width int, height int, channels int, pixels array<int>"
    df = raster.scanlines(spark.createDataFrame(rows, schema))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "pixels" not in generate.rpartition("[")[2]
    assert df.count() == 900
    line = df.where("y = 299 and c = 2").first()["vals"]
    assert line == [((299 * 400 + x) * 3 + 2) % 251 for x in range(400)]
