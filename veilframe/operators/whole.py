"""Boxes of images that fit one task, drawn and blurred in order.

Lines and boxes of an image meet in one sorted partition by a single shuffle. A task holds a
batch of images as flat values, and handles the boxes of one place in the order and of one
shape together, over all images of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.plans.scale import SMALL_IDS, hot_keys, small, written

WHOLE = 1 << 16
"""Most pixels of an image that is handled in one task."""

CORNERS = ["_x0", "_y0", "_x1", "_y1"]
ORDER = ["_det", *CORNERS, "_draw", "_blur"]


def mirrored(p: np.ndarray, n: int) -> np.ndarray:
    """Positions of `p` within 0..n-1, mirrored about the end pixels as often as needed."""
    m = p % max(2 * (n - 1), 1)
    return np.where(m < n, m, 2 * (n - 1) - m)


def is_whole(limit: int = WHOLE) -> Column:
    """Whether a scanline is one of an image that one task handles."""
    return F.col("width").cast("long") * F.col("height") <= limit


def box_means(values: np.ndarray, k: int) -> np.ndarray:
    """Box means of side `k` of each picture in `values` (pictures, lines, columns)."""
    anchor, tail = k // 2, k - 1 - k // 2
    _, m, n = values.shape
    ys, xs = (mirrored(np.arange(-anchor, size + tail), size) for size in (m, n))
    source = values[:, ys][:, :, xs]
    table = np.zeros((len(values), len(ys) + 1, len(xs) + 1), np.int64)
    table[:, 1:, 1:] = source.cumsum(1, dtype=np.int64).cumsum(2)
    sums = table[:, k:, k:] - table[:, :-k, k:] - table[:, k:, :-k] + table[:, :-k, :-k]
    return np.rint(sums / float(k * k))


CELLS = 1 << 21
"""Values, and those that the kernel reaches, of the boxes that one step handles, unless a single box has more."""


def apply_boxes(
    flat: np.ndarray, start: np.ndarray, size: np.ndarray, boxes: pd.DataFrame, k: int, colour: tuple[int, ...], thickness: int
) -> None:
    """Draw and blur boxes in place, those of an image in the order given.

    Images lie in `flat` plane by plane and line by line, from `start` on, and `size` has
    their width, height and channels. `boxes` has `image`, a place in these, the whole-pixel
    corners, which are clipped to the image, and `_draw`, `_blur`.
    """
    image = boxes["image"].to_numpy()
    edge = np.stack([boxes[c].to_numpy() for c in CORNERS], 1).astype(np.int64)
    width, height, channels = size[image].T
    x0, y0 = np.maximum(edge[:, 0], 0), np.maximum(edge[:, 1], 0)
    n, m = np.minimum(edge[:, 2], width) - x0, np.minimum(edge[:, 3], height) - y0
    draw, blur = (boxes[c].to_numpy().astype(bool) for c in ("_draw", "_blur"))
    some = np.flatnonzero((n > 0) & (m > 0) & (draw | blur))
    turn = np.zeros(len(some), int)  # outlines have one colour, so their order is free
    if blur[some].any():
        turn = pd.Series(image[some]).groupby(image[some]).cumcount().to_numpy()
    kinds = np.column_stack([turn, n[some], m[some], channels[some], draw[some], blur[some]])
    order = np.lexsort(kinds.T[::-1])
    kinds, some = kinds[order], some[order]
    ends = np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1
    for first, after in zip(np.append(0, ends), np.append(ends, len(some)), strict=True):
        if first == after:
            continue
        _, w, h, depth, drawn, blurred = kinds[first].tolist()
        plane = np.arange(depth)
        each = max(1, CELLS // (depth * (w + k) * (h + k)))
        for at in range(first, after, each):
            now = some[at : min(after, at + each)]
            own = image[now]
            base = start[own][:, None] + plane * (width[now] * height[now])[:, None]  # of each plane
            base = base + (y0[now] * width[now] + x0[now])[:, None]
            line = base[:, :, None] + np.arange(h) * width[now][:, None, None]
            place = line[..., None] + np.arange(w)
            band = np.zeros((h, w), bool)
            if drawn:
                ys, xs = np.arange(h)[:, None], np.arange(w)
                band |= (ys < thickness) | (ys >= h - thickness) | (xs < thickness) | (xs >= w - thickness)
                for c, shade in enumerate(colour[:depth]):  # a channel beyond those of the colour stays
                    flat[place[:, c, band]] = shade
            if blurred:
                flat[place] = box_means(flat[place].reshape(-1, h, w), k).reshape(place.shape)


def _image(lines: pd.DataFrame, flat: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, list[int], int] | None:
    """One copy of each line of an image that is not plain: values, size, and copies of its first line.

    Lines may be repeated; None for an image without values. A line that is missing or not
    as long as the image is wide is an error.
    """
    if (lines["size"] < 0).all():
        return None
    width, height = (int(lines[c].max()) for c in ("width", "height"))
    if (lines["size"] != width).any() or (lines["width"] != width).any() or (lines["height"] != height).any():
        raise ValueError(f"lines of an image of {width} columns and {height} lines differ in size")
    copies: dict[tuple[int, int], np.ndarray] = {}
    for c, y, at in zip(lines["c"], lines["y"], lines.index, strict=True):
        own = flat[offset[at] : offset[at] + width]
        known = copies.get((c, y))
        copies[c, y] = own if known is None or own.tolist() < known.tolist() else known
    depth = int(lines["c"].max()) + 1
    want = [(c, y) for c in range(depth) for y in range(height)]
    if sorted(copies) != want:
        raise ValueError(f"an image of {depth} planes of {height} lines lacks some of them")
    first = int(((lines["c"] == 0) & (lines["y"] == 0)).sum())
    return np.concatenate([copies[x] for x in want]), [width, height, depth], first


def redacted_batch(batch: pa.Table, k: int, clipped: bool, colour: tuple[int, ...], thickness: int) -> pa.Table:
    """The lines of a batch of whole images, sorted as `painted_whole` says, with their boxes applied."""
    ids = batch["image_id"].combine_chunks()
    change = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
    image = np.append(0, np.cumsum(change))
    box = batch["_box"].to_numpy()
    rows = batch.filter(pa.array(~box))
    if box.all():
        return rows
    vals = rows["vals"].combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vals), -1).to_numpy(zero_copy_only=False)
    offset = np.append(0, np.cumsum(np.maximum(sizes, 0)))
    inner = vals.flatten()
    gaps = pc.is_null(inner).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(inner, 0).to_numpy(zero_copy_only=False).copy()
    lines = pd.DataFrame({c: rows[c].to_numpy() for c in ("width", "height", "c", "y")})
    lines["size"], lines["image"] = sizes, image[~box]
    boxes = pd.DataFrame({c: batch[c].filter(pa.array(box)).to_numpy() for c in ORDER[1:]})
    boxes["image"] = image[box]

    known, begin, count = np.unique(lines["image"], return_index=True, return_counts=True)
    size = np.stack([lines[c].to_numpy()[begin] for c in ("width", "height")] + [lines["c"].to_numpy()[begin + count - 1] + 1], 1).astype(np.int64)
    of = np.repeat(np.arange(len(known)), count)
    within = np.arange(len(lines)) - begin[of]
    as_planned = (within == lines["c"] * size[of, 1] + lines["y"]) & (lines["size"] == size[of, 0]) & (lines["width"] == size[of, 0]) & (lines["height"] == size[of, 1])
    plain = np.logical_and.reduceat(as_planned.to_numpy(), begin) if len(begin) else np.empty(0, bool)
    plain &= count == size[:, 1] * size[:, 2]

    at = np.searchsorted(known, boxes["image"])
    met = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == boxes["image"]) if len(known) else np.zeros(len(boxes), bool)
    boxes = boxes[met].assign(image=at[met])
    if gaps.any():  # an outline covers null values; a blur has no mean of them
        blurred = boxes["image"][boxes["_blur"].astype(bool)]
        if np.isin(of[np.searchsorted(offset, np.flatnonzero(gaps), "right") - 1], blurred).any():
            raise ValueError("an image to blur has null values")
    painted = np.zeros(len(flat) if gaps.any() else 0, np.uint8)
    mine = plain[boxes["image"]]
    apply_boxes(flat, offset[begin], size, boxes[mine], k, colour, thickness)
    if len(painted):
        apply_boxes(painted, offset[begin], size, boxes[mine].assign(_blur=False), 1, (1,) * len(colour), thickness)
    for number, own in boxes[~mine].groupby("image"):
        some = lines.iloc[begin[number] : begin[number] + count[number]]
        one = _image(some, flat, offset)
        if one is None:
            continue
        values, shape, first = one
        if not clipped:  # a box is clipped to, and applied for, each copy of the first line
            own = own.loc[own.index.repeat(first)]
        after = values.copy()
        apply_boxes(after, np.zeros(1, np.int64), np.array([shape], np.int64), own.assign(image=0), k, colour, thickness)
        hit = _covered(own, shape, thickness)
        for c, y, line in zip(some["c"], some["y"], some.index, strict=True):
            old, new = flat[offset[line] : offset[line] + shape[0]], after[(c * shape[1] + y) * shape[0] :][: shape[0]]
            old[hit[y]] = new[hit[y]]  # copies may differ elsewhere
            if len(painted) and c < len(colour):
                painted[offset[line] : offset[line] + shape[0]][hit[y]] = 1
    if len(painted):
        gaps = gaps & (painted == 0)
    done = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(flat, inner.type, mask=gaps), mask=pa.array(sizes < 0))
    return rows.set_column(rows.schema.get_field_index("vals"), "vals", done)


def _covered(boxes: pd.DataFrame, shape: list[int], thickness: int) -> np.ndarray:
    """The pixels of an image that its boxes change: all of a blurred one, the band of another."""
    hit = np.zeros(shape[0] * shape[1], np.uint8)
    start, size = np.zeros(1, np.int64), np.array([[*shape[:2], 1]])
    apply_boxes(hit, start, size, boxes.assign(image=0, _draw=True, _blur=False), 1, (1,), thickness)
    hit = hit.reshape(shape[1], shape[0])
    for box in boxes[boxes["_blur"].astype(bool)].itertuples(index=False):
        x0, y0, x1, y1 = (max(int(v), 0) for v in box[:4])
        hit[y0:y1, x0:x1] = 1
    return hit.astype(bool)


def batches_of_images(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by image in tables of whole images, of about so many bytes."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.nbytes for t in held) < least:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        ids = rows["image_id"]
        ends = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy())
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield rows.slice(0, cut)
        held = [rows.slice(cut)]
    if held and sum(t.num_rows for t in held):
        yield pa.concat_tables(held).combine_chunks()


BYTES = 1 << 23
"""Bytes of lines and boxes that a task handles at a time, about, unless a single image has more."""


def painted_whole(
    scan: DataFrame, boxes: DataFrame, k: int, clipped: bool = True, colour: tuple[int, ...] = (0, 255, 0), thickness: int = 2
) -> DataFrame:
    """Scanlines of images that fit one task, with their boxes applied by `det_id`.

    `boxes` has `image_id, det_id`, whole-pixel corners, `draw` and `blur`; image ids are not
    null. The columns of `scan` stay. There is one shuffle, and no join.
    """
    kinds = {f.name: f.dataType for f in scan.schema}
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    det = boxes.schema["det_id"].dataType
    own = dict.fromkeys(CORNERS, "long") | dict.fromkeys(ORDER[-2:], "boolean")
    lines = scan.select("*", F.lit(False).alias("_box"), none("_det", det), *[none(c, t) for c, t in own.items()])
    others = boxes.select(
        F.col("image_id").try_cast(kinds["image_id"]).alias("image_id"),
        *[none(c, t) for c, t in kinds.items() if c != "image_id"],
        F.lit(True).alias("_box"), F.col("det_id").alias("_det"),
        *[F.col(c[1:]).cast(t).alias(c) for c, t in own.items()],
    )
    met = lines.unionByName(others.where("image_id is not null")).repartition("image_id")
    met = met.sortWithinPartitions("image_id", "_box", "c", "y", *ORDER)
    columns = scan.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of_images(batches, BYTES):
            yield from redacted_batch(rows, k, clipped, colour, thickness).select(columns).to_batches()

    return met.mapInArrow(run, scan.schema)


def divided(
    scan: DataFrame, boxes: DataFrame, fold_limit: int, limit: int = WHOLE
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Lines that no box can touch, lines and boxes of whole images, and the ids of all other images (None: none).

    A whole image has a bounded size and number of boxes. `boxes` is a written table.
    """
    boxes = boxes.where("image_id is not null")
    touched = written(boxes.select("image_id").distinct())
    if touched.limit(SMALL_IDS + 1).count() <= SMALL_IDS:
        untouched, lines = (scan.join(F.broadcast(touched), "image_id", how) for how in ("left_anti", "left_semi"))
    else:  # one shuffle for all is less than those of two joins
        untouched, lines = scan.where("image_id is null"), scan.where("image_id is not null")
    large = written(lines.where(~is_whole(limit)).select("image_id").distinct())
    hot = hot_keys(boxes, ["image_id"], fold_limit)
    if hot is not None:
        large = written(large.unionByName(hot).distinct())
    if large.isEmpty():
        return untouched, lines, boxes, None
    few = small(large, SMALL_IDS)
    return untouched, lines.join(few, "image_id", "left_anti"), boxes.join(few, "image_id", "left_anti"), large
