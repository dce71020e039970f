"""Dense optical flow between neighbouring frames, from quadratic expansions of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scale from a level of the pyramid to the next, levels above the image, edge of the window that displacements are averaged over, rounds on a level, reach and width of an expansion's weights.
SCALE, LEVELS, AVERAGED, ROUNDS, REACH, SIGMA = 0.5, 3, 15, 3, 5, 1.2
#: No level is smaller than this along an edge.
LEAST_EDGE = 16


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a kernel of odd length along an axis, edges repeated."""
    half = len(kernel) // 2
    pad = [(0, 0)] * image.ndim
    pad[axis] = (half, half)
    wide = np.pad(image, pad, mode="edge")
    n = image.shape[axis]
    return sum(k * np.take(wide, range(i, i + n), axis=axis) for i, k in enumerate(kernel))


def _gaussian(sigma: float, half: int) -> np.ndarray:
    g = np.exp(-np.arange(-half, half + 1) ** 2 / (2 * sigma * sigma))
    return g / g.sum()


def expansion(image: np.ndarray, reach: int = REACH, sigma: float = SIGMA) -> np.ndarray:
    """(h, w, 5): of the quadratic that fits each pixel's surroundings best, with weights that fall off, its terms x, y, xx, yy, xy."""
    at = np.arange(-reach, reach + 1, dtype=float)
    g = _gaussian(sigma, reach)
    weight = np.outer(g, g)
    ys, xs = np.meshgrid(at, at, indexing="ij")
    basis = np.stack([np.ones_like(xs), xs, ys, xs * xs, ys * ys, xs * ys]).reshape(6, -1)
    inverse = np.linalg.inv((basis * weight.ravel()) @ basis.T)
    down = {p: _along(image, g * at**p, 0) for p in range(3)}
    moments = np.stack([_along(down[q], g * at**p, 1) for p, q in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))], axis=-1)
    return (moments @ inverse)[..., 1:]


def _sampled(values: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values between four pixels, and whether the place is on the image."""
    h, w = values.shape[:2]
    inside = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    top = values[y0, x0] * (1 - fx) + values[y0, x1] * fx
    low = values[y1, x0] * (1 - fx) + values[y1, x1] * fx
    return top * (1 - fy) + low * fy, inside


def _resized(values: np.ndarray, h: int, w: int) -> np.ndarray:
    """Values between pixels, middles on middles, edges repeated."""
    y = np.clip((np.arange(h) + 0.5) * values.shape[0] / h - 0.5, 0, values.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * values.shape[1] / w - 0.5, 0, values.shape[1] - 1)
    return _sampled(values, *np.meshgrid(y, x, indexing="ij"))[0]


def _improved(first: np.ndarray, second: np.ndarray, flow: np.ndarray, averaged: int) -> np.ndarray:
    """The displacement that carries the first quadratics onto the second ones best, given one to start from."""
    h, w = flow.shape[:2]
    ys, xs = np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij")
    moved, inside = _sampled(second, ys + flow[..., 1], xs + flow[..., 0])
    a = np.where(inside[..., None], (first[..., 2:] + moved[..., 2:]) / 2, first[..., 2:])
    axx, ayy, axy = a[..., 0], a[..., 1], a[..., 2] / 2
    b = np.where(inside[..., None], (first[..., :2] - moved[..., :2]) / 2, 0.0)
    bx = b[..., 0] + axx * flow[..., 0] + axy * flow[..., 1]
    by = b[..., 1] + axy * flow[..., 0] + ayy * flow[..., 1]
    # Normal equations of A d = b, summed over a window.
    parts = np.stack([axx * axx + axy * axy, (axx + ayy) * axy, ayy * ayy + axy * axy, axx * bx + axy * by, axy * bx + ayy * by], axis=-1)
    box = np.full(averaged, 1 / averaged)
    g11, g12, g22, h1, h2 = np.moveaxis(_along(_along(parts, box, 0), box, 1), -1, 0)
    det = g11 * g22 - g12 * g12
    tiny = 1e-3 * (g11 + g22 + 1e-12) ** 2 * 1e-6
    return np.stack([(g22 * h1 - g12 * h2) / (det + tiny), (g11 * h2 - g12 * h1) / (det + tiny)], axis=-1)


def farneback(first: np.ndarray, second: np.ndarray, scale: float = SCALE, levels: int = LEVELS, averaged: int = AVERAGED, rounds: int = ROUNDS, reach: int = REACH, sigma: float = SIGMA) -> np.ndarray:
    """(h, w, 2): where each pixel of the first gray image has gone in the second, x then y.

    Levels of a pyramid, the smallest first; each starts from the flow of the one before, scaled up.
    """
    h, w = first.shape
    flow = None
    for level in range(levels, -1, -1):
        share = scale**level
        lh, lw = round(h * share), round(w * share)
        if level and min(lh, lw) < LEAST_EDGE:
            continue
        blur = (1 / share - 1) / 2
        pair = []
        for image in (first, second):
            image = image.astype(float)
            if blur:
                g = _gaussian(blur, max(1, round(2.5 * blur)))
                image = _resized(_along(_along(image, g, 0), g, 1)[..., None], lh, lw)[..., 0]
            pair.append(expansion(image, reach, sigma))
        flow = np.zeros((lh, lw, 2)) if flow is None else _resized(flow, lh, lw) * (lw / flow.shape[1], lh / flow.shape[0])
        for _ in range(rounds):
            flow = _improved(*pair, flow, averaged)
    return flow


def optical_flow(frames: DataFrame, h: int, w: int, value: str = "gray", key: str = "video", **options) -> DataFrame:
    """frames with dx and dy, arrays of h * w: the way from the frame before to each frame, 0 in a key's first frame.

    ``frames`` has key, idx and an array of gray levels by row. A frame meets
    only the one before it; keys and frames spread over tasks.
    """
    order = Window.partitionBy(key).orderBy("idx")
    pairs = frames.withColumn("_before", F.lag(value).over(order))
    # A schema of its own: add() changes the one it is called on.
    out = T.StructType([*frames.schema.fields, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("dx", "dy"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dx, dy = [], []
            for now, before in zip(batch[value], batch["_before"], strict=True):
                flow = np.zeros((h, w, 2)) if before is None else farneback(np.asarray(before, float).reshape(h, w), np.asarray(now, float).reshape(h, w), **options)
                dx.append(flow[..., 0].ravel())
                dy.append(flow[..., 1].ravel())
            yield batch.drop(columns="_before").assign(dx=dx, dy=dy)

    return pairs.mapInPandas(run, out)
