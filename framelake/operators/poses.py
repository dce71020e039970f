"""Errors between views whose cameras a pose table gives: one pose, a 4 x 4 matrix by row in an array of 16, per frame of a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.geometry import invert_matrix

#: The frames of a pair and the pair's matrix.
PAIR = ["video", "frame", "other"]
#: How far rounding may carry a place on a view's edge beyond it, in parts of half a view.
EDGE = 1e-9


def entries(matrix: Column) -> list[Column]:
    """The 16 entries of an array."""
    return [F.get(matrix, F.lit(k)) for k in range(16)]


def _once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.flatten(F.transform(F.array(value), f))


def multiply(a: Column, b: Column) -> Column:
    """Product of two 4 x 4 matrices."""
    cell = lambda p, i, j: sum((F.get(p.a, F.lit(4 * i + k)) * F.get(p.b, F.lit(4 * k + j)) for k in range(4)), F.lit(0.0))
    return _once(F.struct(a.alias("a"), b.alias("b")), lambda p: F.array(*[cell(p, i, j) for i in range(4) for j in range(4)]))


def inverse(matrix: Column) -> Column:
    """Inverse of a 4 x 4 matrix; nulls where it has none."""
    return _once(matrix, lambda m: invert_matrix(entries(m)))


def matrix_of(values: tuple[float, ...]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def consecutive_pairs(poses: DataFrame) -> DataFrame:
    """video, frame, other, motion, k: each frame with the next one that its video has, both ways.

    ``motion`` takes camera coordinates of ``frame`` to those of ``other``; ``k`` is
    the intrinsic array (fx, fy, cx, cy) of the earlier frame, for both ways.
    ``poses`` has video, frame, pose (camera to world) and k.
    """
    order = Window.partitionBy("video").orderBy("frame")
    met = poses.select("video", "frame", "pose", "k", F.lead("frame").over(order).alias("other"), F.lead("pose").over(order).alias("pose2")).filter("other is not null")
    there = met.select(*PAIR, "k", multiply(inverse(F.col("pose2")), F.col("pose")).alias("motion"))
    back = there.select("video", F.col("other").alias("frame"), F.col("frame").alias("other"), "k", inverse(F.col("motion")).alias("motion"))
    return there.unionByName(back).select(*PAIR, "motion", "k")


def seen_from(px: DataFrame, pairs: DataFrame, w: int, h: int) -> DataFrame:
    """video, frame, other, y, x, z: pixels of ``frame`` at the places, half to even, where ``other`` sees them.

    Of pixels that land together the one with the larger index stays, be it
    behind the camera or not; a point in the camera's own plane lands nowhere.
    """
    met = px.select("video", "frame", "y", "x", "z").join(pairs, ["video", "frame"])
    fx, fy, cx, cy = (F.get("k", F.lit(i)) for i in range(4))
    point = [(F.col("x") - cx) * F.col("z") / fx, (F.col("y") - cy) * F.col("z") / fy, F.col("z")]
    m = entries(F.col("motion"))
    moved = met.select(*PAIR, "k", (F.col("y") * w + F.col("x")).alias("src"), *[(sum((m[4 * i + j] * point[j] for j in range(3)), F.lit(0.0)) + m[4 * i + 3]).alias(n) for i, n in enumerate(("px", "py", "pz"))])
    place = lambda c, f, mid: F.rint(F.try_divide(F.col(c) * f, F.col("pz")) + mid)
    landed = moved.select(*PAIR, "src", "pz", place("px", fx, cx).alias("u"), place("py", fy, cy).alias("v")).filter((F.col("u") >= 0) & (F.col("u") < w) & (F.col("v") >= 0) & (F.col("v") < h))
    best = landed.groupBy(*PAIR, F.col("v").cast("int").alias("y"), F.col("u").cast("int").alias("x")).agg(F.max(F.struct("src", "pz")).alias("best"))
    return best.select(*PAIR, "y", "x", F.col("best.pz").alias("z"))


def temporal_alignment_error(px: DataFrame, poses: DataFrame, w: int, h: int) -> DataFrame:
    """video, tae: mean relative error of depth seen from the next frame and from the one before, in per cent.

    ``px`` has video, frame, y, x, z and mask. A pixel counts where the depth that
    arrives, the own depth and the own mask are all above 0 and set. Pairs
    are those of frames that follow each other in ``poses``; a pair where nothing
    counts is 0, and so is a video of one frame. ``poses`` has one row per frame: video, frame, pose, k.
    """
    pairs = consecutive_pairs(poses)
    own = px.filter((F.col("z") > 0) & F.col("mask")).select("video", F.col("frame").alias("other"), "y", "x", F.col("z").alias("own"))
    met = seen_from(px, pairs, w, h).filter("z > 0").join(own, ["video", "other", "y", "x"])
    each = met.groupBy(*PAIR).agg(F.avg(F.abs(F.col("own") - F.col("z")) / F.col("own")).alias("error"))
    total = each.groupBy("video").agg(F.sum("error").alias("total"))
    frames = poses.groupBy("video").agg(F.count("*").alias("n"))
    return frames.join(total, "video", "left").select("video", (F.coalesce(F.try_divide(F.col("total"), 2 * (F.col("n") - 1)), F.lit(0.0)) * 100).alias("tae"))


def corner_cells(px: DataFrame) -> DataFrame:
    """video, frame, row, column, c00, c01, c10, c11: depth at the corners of each cell between pixels, 0 where there is no pixel.

    Each pixel goes to its four cells once, so that a place finds its four corners by one key.
    """
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    each = px.select("video", "frame", "y", "x", "z", F.explode(corners).alias("c"))
    at = lambda i, j: F.coalesce(F.sum(F.when((F.col("c.i") == i) & (F.col("c.j") == j), F.col("z"))), F.lit(0.0)).alias(f"c{i}{j}")
    return each.groupBy("video", "frame", (F.col("y") - F.col("c.i")).alias("row"), (F.col("x") - F.col("c.j")).alias("column")).agg(*[at(i, j) for i in (0, 1) for j in (0, 1)])


def cross_view_loss(px: DataFrame, poses: DataFrame, intrinsics: tuple[float, ...], w: int, h: int) -> DataFrame:
    """video, loss: sum over all ordered pairs of a video's views, itself included, of the mean difference of sampled and projected depth.

    ``px`` has video, frame, y, x, z, ``poses`` one world-to-camera matrix (pose)
    per frame; ``intrinsics`` is one 4 x 4 matrix. A pixel (x, y, depth z) goes
    through intrinsics, own pose inverted, the other view's pose, intrinsics
    again, and is divided by its fourth coordinate. It counts where x lies in
    [0, w - 1] and y in [0, h - 1], up to EDGE, so that a view sees all of itself; there the other view's depth is taken between four pixels,
    zero beyond the edges and where there is no pixel, at x w / (w - 1) - 1/2
    and likewise for y: places scale as edges of pixels do there, as middles here. A pair in
    which nothing counts has no mean and is left out. The pairs are of a
    sample's few views.
    """
    k = matrix_of(intrinsics)
    views = poses.select("video", "frame", multiply(inverse(F.col("pose")), inverse(k)).alias("away"))
    others = poses.select("video", F.col("frame").alias("other"), multiply(k, F.col("pose")).alias("towards"))
    pairs = views.join(others, "video").select(*PAIR, multiply(F.col("towards"), F.col("away")).alias("way"))
    met = px.select("video", "frame", "y", "x", "z").join(pairs, ["video", "frame"])
    m = entries(F.col("way"))
    given = [F.col("x") * F.col("z"), F.col("y") * F.col("z"), F.col("z")]
    moved = met.select(*PAIR, *[(sum((m[4 * i + j] * given[j] for j in range(3)), F.lit(0.0)) + m[4 * i + 3]).alias(n) for i, n in enumerate("abcd")])
    over = lambda c: F.try_divide(F.col(c), F.col("d"))
    seen = moved.select(*PAIR, (over("a") / ((w - 1) / 2) - 1).alias("u"), (over("b") / ((h - 1) / 2) - 1).alias("v"), over("c").alias("depth")).filter((F.abs("u") <= 1 + EDGE) & (F.abs("v") <= 1 + EDGE))
    seen = seen.withColumn("u", ((F.col("u") + 1) * w - 1) / 2).withColumn("v", ((F.col("v") + 1) * h - 1) / 2)
    seen = seen.withColumn("row", F.floor("v").cast("int")).withColumn("column", F.floor("u").cast("int"))
    cells = corner_cells(px).withColumnRenamed("frame", "other")
    at = seen.join(cells, ["video", "other", "row", "column"], "left")
    fu, fv = F.col("u") - F.col("column"), F.col("v") - F.col("row")
    corner = lambda i, j: F.coalesce(f"c{i}{j}", F.lit(0.0))
    sampled = (corner(0, 0) * (1 - fu) + corner(0, 1) * fu) * (1 - fv) + (corner(1, 0) * (1 - fu) + corner(1, 1) * fu) * fv
    each = at.groupBy(*PAIR).agg(F.avg(F.abs(sampled - F.col("depth"))).alias("loss"))
    return each.groupBy("video").agg(F.sum("loss").alias("loss"))
