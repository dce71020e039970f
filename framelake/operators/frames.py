"""Normalisation, disparity, forward warps, holes, inpainting and stereo layouts, on pixel rows.

Pixel rows have the columns video, frame, y, x. A frame's statistics are one row
per frame and join back on its key; windows and groups are by frame, or by row
of a frame, never wider.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import bit_length, clamp

FRAME = ("video", "frame")
#: Bits of a near score in a packed key.
NEAR_BITS = 20


def quantile_bounds(px: DataFrame, value: str = "depth", low: float = 0.01, high: float = 0.99, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """keys, lo, hi: exact quantiles with linear interpolation."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return px.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def quantile_normalise(px: DataFrame, value: str = "depth", low: float = 0.01, high: float = 0.99, keys: tuple[str, ...] = FRAME, out: str = "norm") -> DataFrame:
    """Add ``out``: value between the frame's quantiles, clamped to [0, 1]."""
    scaled = (F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return px.join(quantile_bounds(px, value, low, high, keys), list(keys)).withColumn(out, clamp(scaled, 0.0, 1.0)).drop("lo", "hi")


def minmax_normalise(px: DataFrame, value: str = "depth", keys: tuple[str, ...] = FRAME, out: str = "norm") -> DataFrame:
    """Add ``out``: value between the least and greatest of its keys; 0 where these are equal."""
    bounds = px.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return px.join(bounds, list(keys)).withColumn(out, scaled).drop("lo", "hi")


def near_and_disparity(px: DataFrame, mode: str = "inverse", max_disparity: float = 16.0) -> DataFrame:
    """Add near and disparity from norm. In mode ``inverse`` large depths are near, in ``metric`` small ones."""
    near = F.col("norm") if mode == "inverse" else 1 - F.col("norm")
    return px.withColumn("near", near).withColumn("disparity", F.col("near") * max_disparity)


def depth_to_inverse(c: Column) -> Column:
    """Reciprocal, 0 where depth isn't positive."""
    return F.when(c > 0, 1 / F.nullif(c, F.lit(0.0))).otherwise(0.0)


def depth_norm(c: Column, least: float, most: float) -> Column:
    """most / depth, clipped to [least, most], over most."""
    return clamp(F.try_divide(F.lit(most), c), least, most) / most


def bit_depth(px: DataFrame, bits: int = 8, reverse: bool = False, value: str = "depth") -> DataFrame:
    """Add level: value over the frame's range in ``bits`` bits. Without ``reverse`` the scale is inverted; a flat frame is 0."""
    most = float(2**bits - 1)
    scaled = F.col("norm") * most
    level = F.floor(scaled if reverse else F.lit(most) - scaled)
    flat = px.groupBy(*FRAME).agg((F.max(value) == F.min(value)).alias("flat"))
    return minmax_normalise(px, value).join(flat, list(FRAME)).withColumn("level", F.when(F.col("flat"), 0).otherwise(level).cast("int")).drop("norm", "flat")


def crop(px: DataFrame, a: int, b: int, c: int, d: int, h: int, w: int) -> DataFrame:
    """Rows a to b and columns c to d, ends counted from the far side if negative or zero for the whole."""
    bottom, right = (b if b > 0 else h + b), (d if d > 0 else w + d)
    return px.filter((F.col("y") >= a) & (F.col("y") < bottom) & (F.col("x") >= c) & (F.col("x") < right))


def shifted(px: DataFrame, w: int) -> DataFrame:
    """Add xt, the column each pixel moves to, and src, its linear index; pixels that leave the frame go."""
    moved = px.withColumn("xt", F.rint(F.col("x") - F.col("disparity")).cast("int")).withColumn("src", (F.col("y") * w + F.col("x")).cast("long"))
    return moved.filter((F.col("xt") >= 0) & (F.col("xt") < w))


def zbuffer_struct(px: DataFrame, w: int, payload: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The nearest pixel that lands on each target, of equals the one with the larger index."""
    best = F.max(F.struct("near", "src", *payload)).alias("best")
    return shifted(px, w).groupBy(*FRAME, "y", "xt").agg(best).select(*FRAME, "y", F.col("xt").alias("x"), "best.src", *[F.col("best")[c].alias(c) for c in payload])


def zbuffer_packed(px: DataFrame, h: int, w: int, payload: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The same with near scores of 20 bits: one long per target is aggregated by hash, and its source's payload joins after."""
    bits = max(NEAR_BITS, bit_length(h * w - 1))
    moved = shifted(px, w)
    near = F.floor(clamp(F.col("near"), 0.0, 1.0) * float(2**NEAR_BITS - 1)).cast("long")
    won = moved.withColumn("packed", F.shiftleft(near, bits).bitwiseOR(F.col("src"))).groupBy(*FRAME, "y", "xt").agg(F.max("packed").alias("packed"))
    won = won.withColumn("src", F.col("packed").bitwiseAND(F.lit((1 << bits) - 1)))
    return won.join(moved.select(*FRAME, "src", *payload), [*FRAME, "src"]).select(*FRAME, "y", F.col("xt").alias("x"), "packed", "src", *payload)


def last_writer(px: DataFrame, deviation: int, payload: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Move by int(norm * deviation) without a depth test: the pixel from the larger column wins."""
    moved = px.withColumn("xt", (F.col("x") - (F.col("norm") * deviation).cast("int")).cast("int")).filter("xt >= 0")
    best = F.max(F.struct("x", *payload)).alias("best")
    return moved.groupBy(*FRAME, "y", "xt").agg(best).select(*FRAME, "y", F.col("xt").alias("x"), F.col("best.x").alias("src_x"), *[F.col("best")[c].alias(c) for c in payload])


def painters(px: DataFrame, w: int, payload: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Points drawn from far to near: the least z of a target stays, of equals the larger index."""
    best = F.max(F.struct((-F.col("z")).alias("near"), "src", *payload)).alias("best")
    return shifted(px, w).groupBy(*FRAME, "y", "xt").agg(best).select(*FRAME, "y", F.col("xt").alias("x"), "best.src", *[F.col("best")[c].alias(c) for c in payload])


def dense_grid(px: DataFrame, h: int, w: int) -> DataFrame:
    """Every (y, x) of each frame that occurs."""
    return (
        px.select(*FRAME).distinct()
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    )


def with_holes(px: DataFrame, h: int, w: int, payload: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The dense grid with the payload where there is a pixel, nulls and hole = true elsewhere."""
    present = px.select(*FRAME, "y", "x", *payload, F.lit(False).alias("hole"))
    return dense_grid(px, h, w).join(present, [*FRAME, "y", "x"], "left").withColumn("hole", F.coalesce("hole", F.lit(True)))


def dilate_left(grid: DataFrame, by: int, w: int) -> DataFrame:
    """Holes spread ``by`` columns to the left; the last ``by`` columns stay as they are."""
    row = Window.partitionBy(*FRAME, "y").orderBy("x")
    spread = F.max(F.col("hole").cast("int")).over(row.rowsBetween(0, by)) == 1
    return grid.withColumn("hole", F.when(F.col("x") < w - by, spread).otherwise(F.col("hole")))


def box_inpaint(grid: DataFrame, kernel: int = 7, channels: tuple[str, ...] = ("r", "g", "b"), mode: str = "compat", rounds: int = 1) -> DataFrame:
    """Fill holes of a dense grid by the mean of the known pixels in a box.

    ``compat`` is one pass that fills every hole, with 0 where the box knows
    nothing. ``iterative`` leaves such holes to the next of ``rounds`` passes.
    The box is two one-dimensional sums: along x, then along y.
    """
    half = kernel // 2
    along_x = Window.partitionBy(*FRAME, "y").orderBy("x").rowsBetween(-half, half)
    along_y = Window.partitionBy(*FRAME, "x").orderBy("y").rowsBetween(-half, half)
    for _ in range(rounds if mode == "iterative" else 1):
        known = (~F.col("hole")).cast("int")
        sums = grid.withColumn("_n", F.sum(known).over(along_x))
        for c in channels:
            sums = sums.withColumn(f"_{c}", F.sum(F.when(F.col("hole"), 0.0).otherwise(F.col(c))).over(along_x))
        sums = sums.withColumn("_n", F.sum("_n").over(along_y))
        for c in channels:
            sums = sums.withColumn(f"_{c}", F.sum(f"_{c}").over(along_y))
        for c in channels:
            mean = F.col(f"_{c}") / F.greatest(F.col("_n"), F.lit(1))
            empty = F.lit(None).cast("double") if mode == "iterative" else F.lit(0.0)
            sums = sums.withColumn(c, F.when(~F.col("hole"), F.col(c)).otherwise(F.when(F.col("_n") > 0, mean).otherwise(empty)))
        still = F.col("hole") & (F.col("_n") == 0) if mode == "iterative" else F.lit(False)
        grid = sums.withColumn("hole", still).drop("_n", *[f"_{c}" for c in channels])
    return grid


def sequential_fill(image: np.ndarray, hole: np.ndarray, kernel: int = 7) -> np.ndarray:
    """Raster-order fill in place: each hole takes the truncated mean of what its box knows so far, row 0 and column 0 left out."""
    image, hole, half = image.astype(np.int64).copy(), hole.copy(), kernel // 2
    changed = True
    while changed:
        changed = False
        for y, x in np.argwhere(hole):
            box = np.s_[max(1, y - half) : y + half + 1, max(1, x - half) : x + half + 1]
            known = ~hole[box]
            if known.any():
                image[y, x] = image[box][known].sum(axis=0) // known.sum()
                hole[y, x] = False
                changed = True
    return image


def sequential_inpaint(grid: DataFrame, h: int, w: int, kernel: int = 7) -> DataFrame:
    """Fill holes one after another; a frame's grid, its r, g, b as integers, is one group."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        image = rows[["r", "g", "b"]].fillna(0).to_numpy().reshape(h, w, 3)
        rows[["r", "g", "b"]] = sequential_fill(image, rows["hole"].to_numpy().reshape(h, w), kernel).reshape(-1, 3)
        return rows

    ready = grid.select(*FRAME, "y", "x", *[F.col(c).cast("int").alias(c) for c in "rgb"], "hole")
    return ready.groupBy(*FRAME).applyInPandas(fill, ready.schema)


def compose_stereo(left: DataFrame, right: DataFrame, layout: str, h: int, w: int, alpha: float = 0.5) -> DataFrame:
    """Both views as one image: ``sbs`` side by side, ``ou`` over and under, ``overlay`` blended, ``anaglyph`` red from the left.

    The right view is moved and appended for the first two; the other two meet by pixel.
    """
    columns = [*FRAME, "y", "x", "r", "g", "b"]
    if layout == "sbs":
        return left.select(columns).unionByName(right.withColumn("x", F.col("x") + w).select(columns))
    if layout == "ou":
        return left.select(columns).unionByName(right.withColumn("y", F.col("y") + h).select(columns))
    both = left.select(columns).join(right.select(*columns[:4], *[F.col(c).alias(f"{c}2") for c in "rgb"]), columns[:4])
    if layout == "overlay":
        a = min(max(alpha, 0.0), 1.0)
        return both.select(*columns[:4], *[(F.col(c) * (1 - a) + F.col(f"{c}2") * a).alias(c) for c in "rgb"])
    if layout == "anaglyph":
        return both.select(*columns[:4], "r", F.col("g2").alias("g"), F.col("b2").alias("b"))
    raise ValueError(f"unknown layout {layout}")


def mask_sets(px: DataFrame, first: Column, second: Column) -> DataFrame:
    """video, frame, either, both: pixels of the union and of the intersection of two masks; null is outside."""
    return px.groupBy(*FRAME).agg(F.count(F.when(first | second, 1)).alias("either"), F.count(F.when(first & second, 1)).alias("both"))


def mask_iou(px: DataFrame, first: Column, second: Column) -> DataFrame:
    """Intersection over union of two masks by frame, null for two empty masks."""
    a, b = first.cast("int"), second.cast("int")
    return px.groupBy(*FRAME).agg(F.try_divide(F.sum(a * b), F.sum(F.greatest(a, b))).alias("iou"))


def bounding_box(px: DataFrame, mask: Column) -> DataFrame:
    """Least and greatest row and column of a mask by frame."""
    return px.filter(mask).groupBy(*FRAME).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
