"""A small, plain model of the pixel rules, one box at a time."""

import numpy as np


def mirrored(p: int, n: int) -> int:
    if n == 1:
        return 0
    p %= 2 * (n - 1)
    return p if p < n else 2 * (n - 1) - p


def mean_of(roi: np.ndarray, k: int) -> np.ndarray:
    height, width = roi.shape
    out = np.empty_like(roi)
    for y in range(height):
        for x in range(width):
            ys = [mirrored(y + i - k // 2, height) for i in range(k)]
            xs = [mirrored(x + i - k // 2, width) for i in range(k)]
            total = int(roi[np.ix_(ys, xs)].astype(int).sum())
            out[y, x] = int(np.rint(total / (k * k)))
    return out


def redact(image: np.ndarray, boxes: list[dict], k: int) -> np.ndarray:
    """`image` is height x width x channels; boxes are clipped and applied in order."""
    out = image.astype(int).copy()
    height, width, channels = out.shape
    for box in sorted(boxes, key=lambda b: b["det_id"]):
        x0, y0 = max(box["x0"], 0), max(box["y0"], 0)
        x1, y1 = min(box["x1"], width), min(box["y1"], height)
        if x1 <= x0 or y1 <= y0:
            continue
        if box.get("draw", False):
            roi = out[y0:y1, x0:x1]
            edge = np.ones(roi.shape[:2], dtype=bool)
            edge[2:-2, 2:-2] = False
            roi[edge] = (0, 255, 0)[:channels]
        if box.get("blur", True):
            for c in range(channels):
                out[y0:y1, x0:x1, c] = mean_of(out[y0:y1, x0:x1, c], k)
    return out
