"""Inpainting by fast marching: holes are filled from their rim inwards, each pixel from known ones near it."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.frames import FRAME, last_writer, minmax_normalise, with_holes

#: What a pixel is on the way: its value stands, it is on the rim, it has none yet.
KNOWN, BAND, INSIDE = 0, 1, 2
FAR = 1e6
_NEAR4 = ((-1, 0), (0, -1), (1, 0), (0, 1))


def _arrival(time: np.ndarray, state: np.ndarray, y: int, x: int) -> float:
    """When the front gets to a pixel: the least solution of |grad T| = 1 over the four pairs of neighbours that it has passed."""
    h, w = time.shape
    passed = lambda a, b: time[a, b] if 0 <= a < h and 0 <= b < w and state[a, b] != INSIDE else FAR
    best = FAR
    for dy in (-1, 1):
        for dx in (-1, 1):
            p, q = passed(y + dy, x), passed(y, x + dx)
            if p == FAR and q == FAR:
                continue
            if p == FAR or q == FAR or abs(p - q) >= 1:
                best = min(best, min(p, q) + 1)
            else:
                best = min(best, (p + q + np.sqrt(2 - (p - q) ** 2)) / 2)
    return best


def _rim(hole: np.ndarray) -> list[tuple[int, int]]:
    """Known pixels with a hole among their four neighbours."""
    h, w = hole.shape
    return [(y, x) for y, x in np.argwhere(~hole) if any(0 <= y + a < h and 0 <= x + b < w and hole[y + a, x + b] for a, b in _NEAR4)]


def _march(start: list[tuple[int, int]], state: np.ndarray, time: np.ndarray, until: float, reached) -> None:
    """Send a front out from ``start`` through what is INSIDE; ``reached`` is told of each pixel once, before it counts as passed."""
    h, w = time.shape
    queue = [(0.0, y, x) for y, x in start]
    for y, x in start:
        time[y, x], state[y, x] = 0.0, BAND
    heapq.heapify(queue)
    while queue:
        at, y, x = heapq.heappop(queue)
        if at > until:
            break
        state[y, x] = KNOWN
        for a, b in _NEAR4:
            v, u = y + a, x + b
            if 0 <= v < h and 0 <= u < w and state[v, u] == INSIDE:
                time[v, u] = _arrival(time, state, v, u)
                reached(v, u)
                state[v, u] = BAND
                heapq.heappush(queue, (float(time[v, u]), v, u))


def _slope(values: np.ndarray, state: np.ndarray, y: int, x: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences along y and x between neighbours that aren't INSIDE; 0 where there is none."""
    h, w = state.shape
    there = lambda a, b: 0 <= a < h and 0 <= b < w and state[a, b] != INSIDE

    def along(a: int, b: int):
        after, before = there(y + a, x + b), there(y - a, x - b)
        if after and before:
            return (values[y + a, x + b] - values[y - a, x - b]) / 2
        if after:
            return values[y + a, x + b] - values[y, x]
        return values[y, x] - values[y - a, x - b] if before else np.zeros_like(values[y, x])

    return along(1, 0), along(0, 1)


def marching_fill(image: np.ndarray, hole: np.ndarray, radius: int = 2) -> np.ndarray:
    """(h, w, channels) with holes filled, as floats.

    A pixel takes the weighted mean over the known pixels within ``radius`` of their value, carried
    on along their own slope. Weights rise with how much a pixel lies along the
    front's direction, with nearness, and with nearness to the same front. An image without any known pixel stays.
    """
    image, hole = image.astype(float).copy(), hole.astype(bool)
    rim = _rim(hole)
    if not rim:
        return image
    h, w = hole.shape
    # Outside the holes, the front runs the other way, so that time falls with the distance there.
    outside = np.where(hole, KNOWN, INSIDE)
    time = np.full((h, w), FAR)
    for y, x in rim:
        outside[y, x] = BAND
    _march(rim, outside, time, 2 * radius, lambda y, x: None)
    time = np.where(hole, FAR, -time)
    state = np.where(hole, INSIDE, KNOWN)

    def fill(y: int, x: int) -> None:
        gy, gx = _slope(time, state, y, x)
        total, mean = 0.0, np.zeros(image.shape[2])
        for v in range(max(0, y - radius), min(h, y + radius + 1)):
            for u in range(max(0, x - radius), min(w, x + radius + 1)):
                ry, rx = y - v, x - u
                far = ry * ry + rx * rx
                if state[v, u] == INSIDE or not 0 < far <= radius * radius:
                    continue
                along = abs(ry * gy + rx * gx) / np.sqrt(far)
                weight = max(along, 1e-6) / far / (1 + abs(time[v, u] - time[y, x]))
                sy, sx = _slope(image, state, v, u)
                mean += weight * (image[v, u] + sy * ry + sx * rx)
                total += weight
        image[y, x] = mean / total

    _march(rim, state, time, FAR, fill)
    return image


def marching_inpaint(grid: DataFrame, h: int, w: int, radius: int = 2) -> DataFrame:
    """Fill the holes of frames (video, frame, y, x, r, g, b, hole) by fast marching, to whole levels within 0 to 255.

    A frame's grid is one group and goes through one task, as each pixel needs those filled before it.
    """

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        image = rows[["r", "g", "b"]].fillna(0).to_numpy().reshape(h, w, 3)
        filled = marching_fill(image, rows["hole"].to_numpy().reshape(h, w), radius)
        rows[["r", "g", "b"]] = np.clip(np.rint(filled), 0, 255).astype(int).reshape(-1, 3)
        return rows

    ready = grid.select(*FRAME, "y", "x", *[F.col(c).cast("int").alias(c) for c in "rgb"], "hole")
    return ready.groupBy(*FRAME).applyInPandas(fill, ready.schema)


def baseline_stereo_marched(px: DataFrame, h: int, w: int, deviation: int, radius: int = 2) -> DataFrame:
    """The right view of the early pipeline in its second form: depth by its range, moved without a depth test, holes filled by marching."""
    moved = last_writer(minmax_normalise(px), deviation)
    return marching_inpaint(with_holes(moved.filter(F.col("x") < w), h, w), h, w, radius)
