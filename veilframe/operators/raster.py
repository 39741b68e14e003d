"""Pixel work on scanlines.

A raster is a set of scanlines, one row per image, channel and line:
`image_id, width, height, c, y, vals ARRAY<INT>`. A row is bounded by the image width,
so an image of any height is spread over tasks, and boxes meet scanlines by an equality
join on `(image_id, y)`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.geometry import has_area, reflect
from veilframe.operators.whole import divided, mirrored, painted_whole
from veilframe.plans.scale import FOLD_LIMIT, restricted, tidy, written

SCAN = ["image_id", "width", "height", "c", "y", "vals"]


def scanlines(rasters: DataFrame) -> DataFrame:
    """Unpack rasters (`pixels` row by row, channels last) without a shuffle.

    All lines of a raster are built in one expression and then exploded without `pixels`,
    so the work is linear in its size.
    """
    width, channels = F.col("width"), F.col("channels")
    at = lambda line, x: F.floor(line / channels).cast("int") * width * channels + x * channels + line % channels
    plain = lambda line: F.slice("pixels", line * width + 1, width)
    picked = lambda line: F.transform(
        F.sequence(F.lit(0), width - 1), lambda x: F.get("pixels", at(line, x))
    )
    line_of = lambda line: F.struct(
        (line % channels).alias("c"),
        F.floor(line / channels).cast("int").alias("y"),
        F.when(channels == 1, plain(line)).otherwise(picked(line)).alias("vals"),
    )
    lines = F.transform(F.sequence(F.lit(0), F.col("height") * channels - 1), line_of)
    some = rasters.where((width > 0) & (F.col("height") > 0))
    return some.select("image_id", "width", "height", F.inline(lines))


def pixels(scan: DataFrame) -> DataFrame:
    """One row per pixel and channel."""
    return scan.select("image_id", "c", "y", F.posexplode_outer("vals").alias("x", "v"))


def image_sizes(scan: DataFrame) -> DataFrame:
    """Size per image, from its first scanline."""
    first = scan.where((F.col("y") == 0) & (F.col("c") == 0))
    return first.select("image_id", "width", "height")


def clip_boxes(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cut boxes to their image; boxes fully outside are left out."""
    zero = F.lit(0)
    cut = boxes.join(sizes, "image_id").withColumns(
        {
            "x0": F.greatest("x0", zero),
            "y0": F.greatest("y0", zero),
            "x1": F.least("x1", "width"),
            "y1": F.least("y1", "height"),
        }
    )
    return cut.where(has_area()).drop("width", "height")


def pixels_in_boxes(scan: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside half-open boxes: one row per pixel, channel and box.

    Boxes become one row per line they cover and meet the scanlines by equality, so the
    only candidates are lines that really cross the box.
    """
    lines = boxes.where(has_area()).select(
        "image_id", "det_id", "x0", "x1", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y")
    )
    low, high = F.greatest("x0", F.lit(0)), F.least("x1", "width") - 1
    hit = scan.join(lines, ["image_id", "y"]).where(low <= high)
    return hit.select(
        "image_id", "det_id", "c", "y", "vals", F.explode(F.sequence(low, high)).alias("x")
    ).select("image_id", "det_id", "c", "y", "x", F.get("vals", F.col("x")).alias("v"))


TILE = 64
"""Side of the tiles that a box is blurred in; a tile also needs the pixels that the kernel reaches."""


def tile_means(tile: tuple, k: int) -> np.ndarray:
    """Box means of a tile from its pixels and those around it, by a summed-area table."""
    anchor, tail = k // 2, k - 1 - k // 2
    ys = np.searchsorted(tile.rows, mirrored(np.arange(tile.top - anchor, tile.bottom + tail), tile.m))
    xs = mirrored(np.arange(tile.left - anchor, tile.right + tail), tile.n) - tile.low
    source = tile.flat.reshape(len(tile.rows), -1)[ys][:, xs]
    table = np.zeros((len(ys) + 1, len(xs) + 1), np.int64)
    table[1:, 1:] = source.cumsum(0, dtype=np.int64).cumsum(1)
    sums = table[k:, k:] - table[:-k, k:] - table[k:, :-k] + table[:-k, :-k]
    return np.rint(sums / float(k * k)).astype(np.int32)


def blur_segments(scan: DataFrame, boxes: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """Box mean of side `k` inside each box, as line segments `x0, seg`.

    The box is blurred as an image of its own: lines and columns are first extended by
    mirroring about the end pixels of the box. Boxes are cut into tiles, and a tile gets the
    part of each line that its means need, so a task holds a tile and the reach of the kernel
    at a time, and pixels are never rows. Boxes must lie inside their image.
    """
    anchor, tail = k // 2, k - 1 - k // 2
    corner = ["image_id", "det_id", "x0", "y0", "n", "m"]
    reached = lambda first, last, n: f"transform(sequence({first} - {anchor}, {last} - 1 + {tail}), p -> {reflect('p', n)})"
    columns = f"""transform(transform(sequence(0, n - 1, {tile}), l -> struct(l, least(n, l + {tile}) as r)),
        t -> struct(t.l as left, t.r as right,
          array_min({reached('t.l', 't.r', 'n')}) as low, array_max({reached('t.l', 't.r', 'n')}) as high))"""
    lines = (
        boxes.where(has_area())
        .selectExpr("image_id", "det_id", "x0", "y0", "x1 - x0 as n", "y1 - y0 as m")
        .selectExpr(*corner, f"{columns} as cols", f"explode(sequence(0, m - 1, {tile})) as top")
        .selectExpr(*corner, "cols", "top", f"least(m, top + {tile}) as bottom")
        .selectExpr(*corner, "cols", "top", "bottom", f"explode(array_distinct({reached('top', 'bottom', 'm')})) as row")
        .selectExpr(*corner, "cols", "top", "bottom", "row", "y0 + row as y")
    )
    parts = (
        scan.select("image_id", "c", "y", "vals")
        .join(lines, ["image_id", "y"])
        .selectExpr(*corner, "c", "top", "bottom", "row", "vals", "inline(cols)")
        .selectExpr(*corner, "c", "top", "bottom", "left", "right", "low", "row", "slice(vals, x0 + low + 1, high - low + 1) as part")
    )
    fixed = ["x0", "y0", "n", "m", "bottom", "right", "low"]
    tiles = (
        parts.groupBy("image_id", "det_id", "c", "top", "left")
        .agg(*[F.any_value(x).alias(x) for x in fixed], F.sort_array(F.collect_list(F.struct("row", "part"))).alias("lines"))
        .selectExpr("image_id", "c", "top", "left", *fixed, "lines.row as rows", "flatten(lines.part) as flat")
    )

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [tile_means(t, k) for t in batch.itertuples(index=False)]
            out = batch[["image_id", "c"]].assign(y=batch["y0"] + batch["top"], x0=batch["x0"] + batch["left"])
            out["width"] = [d.shape[1] for d in done]
            out["flat"] = [d.ravel() for d in done]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in scan.schema}
    shape = f"image_id {kinds['image_id']}, c {kinds['c']}, y int, x0 int, width int, flat array<int>"
    blurred = tiles.mapInPandas(means, shape)
    count = "cast(size(flat) div width as int)"
    cut = f"posexplode(transform(sequence(0, {count} - 1), i -> slice(flat, i * width + 1, width)))"
    return blurred.selectExpr("image_id", "c", "y", "x0", f"{cut} as (i, seg)").selectExpr("image_id", "c", "y + i as y", "x0", "seg")


def box_blur(scan: DataFrame, boxes: DataFrame, k: int) -> DataFrame:
    """Blur boxes that do not overlap; the rest of the raster stays as it is."""
    return paint(scan, blur_segments(scan, boxes, k))


def _spliced(patches: str, values: str, length: str) -> str:
    """`vals` with sorted, disjoint patches put in, in one pass.

    `values` and `length` are SQL about a patch `p`; a patch starts at its `x0`.
    """
    end = lambda p: f"({p}.x0 + {length.replace('p.', f'{p}.')})"
    before = f"if(i = 0, 0, {end(f'get({patches}, i - 1)')})"
    return f"""if({patches} is null, vals, concat(
        flatten(transform({patches}, (p, i) -> concat(slice(vals, {before} + 1, p.x0 - {before}), {values}))),
        slice(vals, {end(f'element_at({patches}, -1)')} + 1, size(vals))))"""


def paint(scan: DataFrame, segments: DataFrame) -> DataFrame:
    """Replace line segments (`x0, seg`) of scanlines; segments of a line are disjoint."""
    patches = segments.groupBy("image_id", "c", "y").agg(
        F.sort_array(F.collect_list(F.struct("x0", "seg"))).alias("_patches")
    )
    kept = [c for c in scan.columns if c != "vals"]
    painted = F.expr(_spliced("_patches", "p.seg", "size(p.seg)")).alias("vals")
    return scan.join(patches, ["image_id", "c", "y"], "left").select(*kept, painted)


def run_union(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal disjoint runs (`x0, n`) that cover the same places as the given ones, per line.

    Runs become steps up and down, and steps at one place are summed, map-side first: a line
    gets at most one row per place and task, however many runs it has.
    """
    steps = runs.where("n > 0").selectExpr(*keys, "inline(array(struct(x0 as x, 1L as d), struct(x0 + n as x, -1L as d)))")
    turns = steps.groupBy(*keys, "x").agg(F.sum("d").alias("d")).where("d <> 0")
    along = Window.partitionBy(*keys).orderBy("x")
    depth = F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0))
    ends = turns.withColumn("_depth", depth).withColumn("_before", F.col("_depth") - F.col("d"))
    ends = ends.where("_depth = 0 or _before = 0").withColumn("_next", F.lead("x").over(along))
    return ends.where("_before = 0").select(*keys, F.col("x").alias("x0"), (F.col("_next") - F.col("x")).alias("n"))


def outline_runs(boxes: DataFrame, thickness: int = 2) -> DataFrame:
    """Disjoint runs (image_id, y, x0, n) of the outlines of boxes: at most half a width per line."""
    edge = f"y < y0 + {thickness} or y >= y1 - {thickness} or x1 - x0 <= {2 * thickness}"
    ends = f"array(struct(x0, {thickness} as n), struct(x1 - {thickness} as x0, {thickness} as n))"
    runs = (
        boxes.where(has_area())
        .selectExpr("image_id", "x0", "y0", "x1", "y1", "explode(sequence(y0, y1 - 1)) as y")
        .selectExpr("image_id", "y", f"inline(if({edge}, array(struct(x0, x1 - x0 as n)), {ends}))")
    )
    return run_union(runs, ["image_id", "y"])


@tidy
def draw_outlines(
    scan: DataFrame, boxes: DataFrame, colour: tuple[int, ...] = (0, 255, 0), thickness: int = 2, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Draw box outlines: the band of `thickness` pixels inside the edge of each box.

    Images that fit one task are drawn as a whole, the others line by line.
    """
    wanted = boxes.where(has_area()).select("image_id", "x0", "y0", "x1", "y1")
    wanted = written(wanted.selectExpr("*", "0 as det_id", "true as draw", "false as blur"))
    untouched, lines, own, large = divided(scan, wanted, fold_limit)
    done = untouched.unionByName(painted_whole(lines, own, 1, True, colour, thickness))
    if large is None:
        return done
    some, marked = (restricted(df, large, "image_id") for df in (scan, wanted))
    return done.unionByName(outlined_lines(some, marked, colour, thickness))


def outlined_lines(
    scan: DataFrame, boxes: DataFrame, colour: tuple[int, ...] = (0, 255, 0), thickness: int = 2
) -> DataFrame:
    """Draw box outlines on images of any size, with any number of boxes.

    Outlines have one colour, so their order is free: the runs of a line are united first
    and painted in one pass.
    """
    runs = outline_runs(boxes, thickness).groupBy("image_id", "y").agg(
        F.sort_array(F.collect_list(F.struct("x0", "n"))).alias("_runs")
    )
    shade = f"get(array({', '.join(str(v) for v in colour)}), c)"
    painted = F.expr(_spliced("_runs", f"array_repeat({shade}, p.n)", "p.n")).alias("vals")
    kept = [c for c in scan.columns if c != "vals"]
    return scan.join(runs, ["image_id", "y"], "left").select(*kept, painted)


def swap_channels(scan: DataFrame) -> DataFrame:
    """Exchange the first and the last of three channels."""
    return scan.withColumn("c", F.lit(2) - F.col("c"))


def pad(scan: DataFrame, top: Column, bottom: Column, left: Column, right: Column, fill: int) -> DataFrame:
    """Add a constant border; a map over scanlines, with no shuffle.

    The first line of an image also produces the lines above it, the last one those below.
    """
    wide = F.concat(
        F.array_repeat(F.lit(fill), left), F.col("vals"), F.array_repeat(F.lit(fill), right)
    )
    blank = F.array_repeat(F.lit(fill), F.col("width") + left + right)
    above = F.when(F.col("y") == 0, F.array_repeat(blank, top)).otherwise(F.array())
    below = F.when(F.col("y") == F.col("height") - 1, F.array_repeat(blank, bottom)).otherwise(F.array())
    first = F.when(F.col("y") == 0, F.lit(0)).otherwise(F.col("y") + top)
    return scan.select(
        "image_id",
        (F.col("width") + left + right).alias("width"),
        (F.col("height") + top + bottom).alias("height"),
        "c",
        first.alias("_first"),
        F.posexplode(F.concat(above, F.array(wide), below)).alias("_off", "vals"),
    ).select(
        "image_id", "width", "height", "c", (F.col("_first") + F.col("_off")).cast("int").alias("y"), "vals"
    )


BAND_LINES = 64
"""Target lines of a band, which is resampled in one task."""


def _with_sizes(scan: DataFrame, sizes: DataFrame) -> DataFrame:
    """Scanlines with `new_width, new_height` of their image.

    A size is repeated for each residue of line numbers, so that the lines of one image are
    spread over tasks also when the sizes are too many to broadcast.
    """
    salt = F.pmod(F.col("y"), F.lit(SPREAD)).cast("int")
    each = sizes.select("image_id", "new_width", "new_height", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_salt"))
    return scan.withColumn("_salt", salt).join(each, ["image_id", "_salt"]).drop("_salt")


SPREAD = 16
"""Tasks that the lines of an image are spread over, at most, to learn its new size."""


def resample(scan: DataFrame, sizes: DataFrame, whole: bool = True, band: int = BAND_LINES) -> DataFrame:
    """Bilinear resampling to the sizes in `sizes` (`image_id, new_width, new_height`).

    Pixel centres are at half positions and edges are clamped. Images already of the
    right size stay as they are. With `whole` values are rounded to integers.

    A source line is stretched where it lies and sent to the bands of target lines that it
    is a tap of, two at most unless it is repeated many times. A band is one group, so an
    image of any height is spread over tasks.
    """
    sized = _with_sizes(scan, sizes)
    equal = (F.col("width") == F.col("new_width")) & (F.col("height") == F.col("new_height"))
    # images of the right size skip the second shuffle
    same = sized.where(equal).drop("new_width", "new_height")
    other = sized.where(~equal)

    def source(i: Column, n_in: Column, n_out: Column) -> Column:
        centre = (i + F.lit(0.5)) * n_in.cast("double") / n_out.cast("double") - F.lit(0.5)
        return F.greatest(F.lit(0.0), centre)

    def across(i: Column) -> Column:
        s = source(i, F.col("width"), F.col("new_width"))
        low = F.floor(s).cast("int")
        high = F.least(low + 1, F.col("width") - 1)
        frac = s - low
        return (F.lit(1.0) - frac) * F.get("vals", low) + frac * F.get("vals", high)

    def taps(t: Column) -> tuple[Column, Column, Column]:
        """Upper and lower source line of a target line, and the weight of the lower one."""
        s = source(t, F.col("height"), F.col("new_height"))
        upper = F.floor(s).cast("int")
        return upper, F.least(upper + 1, F.col("height") - 1), s - upper

    # the target lines that have a source line as upper or lower tap, and some around them
    n_in, n_out = F.col("height").cast("double"), F.col("new_height").cast("double")
    reach_low = F.floor((F.col("y") - F.lit(0.5)) * n_out / n_in - F.lit(1.5))
    reach_high = F.ceil((F.col("y") + F.lit(1.5)) * n_out / n_in + F.lit(0.5))
    low = F.greatest(F.lit(0).cast("bigint"), reach_low)
    high = F.least(F.col("new_height").cast("bigint") - 1, reach_high)
    # targets beyond the first and last centre are clamped onto the edge lines
    low = F.when(F.col("y") <= 1, F.lit(0).cast("bigint")).otherwise(low)
    high = F.when(F.col("y") == F.col("height") - 1, F.col("new_height").cast("bigint") - 1).otherwise(high)

    def is_tap(t: Column) -> Column:
        upper, lower, _ = taps(t)
        return (F.col("y") == upper) | (F.col("y") == lower)

    targets = F.filter(F.when(low <= high, F.sequence(low, high)), is_tap)
    bands = F.array_distinct(F.transform(targets, lambda t: F.floor(t / band).cast("int")))
    stretched = other.select("image_id", "c", "y", "height", "width", "vals", "new_width", "new_height", bands.alias("bands")).where("size(bands) > 0")
    stretched = stretched.select(
        "image_id", "c", "y", "height", "new_width", "new_height", "bands",
        F.transform(F.sequence(F.lit(0), F.col("new_width") - 1), across).alias("h"),
    )
    sent = stretched.select("*", F.explode("bands").alias("band")).drop("bands")
    groups = sent.groupBy("image_id", "c", "band").agg(
        *[F.any_value(c).alias(c) for c in ("height", "new_width", "new_height")],
        F.map_from_entries(F.collect_list(F.struct("y", "h"))).alias("lines"),
    )

    def mixed(t: Column) -> Column:
        upper, lower, frac = taps(t)
        line = F.zip_with(
            F.element_at("lines", upper), F.element_at("lines", lower),
            lambda a, b: (F.lit(1.0) - frac) * a + frac * b,
        )
        return F.struct(t.cast("int").alias("y"), (F.transform(line, lambda v: F.rint(v).cast("int")) if whole else line).alias("vals"))

    last = F.least(F.col("new_height"), (F.col("band") + 1) * band) - 1
    lines = F.transform(F.sequence(F.col("band") * band, last), mixed)
    done = groups.select("image_id", "new_width", "new_height", "c", F.inline(lines))
    done = done.withColumnsRenamed({"new_width": "width", "new_height": "height"})
    if whole:
        same = same.select(*SCAN)
    else:
        same = same.select(*SCAN[:-1], F.col("vals").cast("array<double>").alias("vals"))
    return done.select(*SCAN).unionByName(same)


TENSOR_VALUES = 1 << 24
"""Most values of a model input."""


def to_tensor(scan: DataFrame, most: int = TENSOR_VALUES) -> DataFrame:
    """Model input per image: channels first, values 0..1 as floats, plus its shape.

    An image becomes one row here, so its size is that of the model input, not of the
    source: letterbox it first. The run fails on an image of more than `most` values.
    """
    values = F.col("width").cast("long") * F.col("height") * (F.col("c") + 1)
    refused = F.raise_error(F.concat(F.lit("image "), F.col("image_id").cast("string"), F.lit(f" has more than {most} values: letterbox it first")))
    scan = scan.withColumn("vals", F.when(values > most, refused).otherwise(F.col("vals")))
    lines = F.sort_array(F.collect_list(F.struct("c", "y", "vals")))
    flat = F.flatten(F.transform(lines, lambda line: line["vals"]))
    scaled = F.transform(flat, lambda v: (v / F.lit(255.0)).cast("float"))
    return scan.groupBy("image_id").agg(
        F.array(F.lit(1), F.max("c") + 1, F.max("height"), F.max("width")).alias("shape"),
        scaled.alias("tensor"),
    )
