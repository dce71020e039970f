"""Resampling of dense grids on pixel rows, and the rules that solve for a size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.frames import FRAME


def axis_weights(spark: SparkSession, name: str, source: int, target: int, align_corners: bool = False) -> DataFrame:
    """<name>, <name>_t, w<name>: for each target index its one or two source indices and their weights. As long as an image's edge."""
    rows = []
    for t in range(target):
        at = (t * (source - 1) / (target - 1) if target > 1 else 0.0) if align_corners else max((t + 0.5) * source / target - 0.5, 0.0)
        low = min(int(at), source - 1)
        rows += [(low, t, 1 - (at - low))] + ([(low + 1, t, at - low)] if low + 1 < source else [])
        if low + 1 >= source:
            rows[-1] = (low, t, 1.0)
    return spark.createDataFrame(rows, f"{name} int, {name}_t int, w{name} double")


def bilinear(grid: DataFrame, h: int, w: int, new_h: int, new_w: int, align_corners: bool = False, value: str = "depth") -> DataFrame:
    """video, frame, y, x, value of a resized dense grid, without antialiasing. The weight tables are an edge long and go out by broadcast."""
    spark = grid.sparkSession
    ys, xs = axis_weights(spark, "y", h, new_h, align_corners), axis_weights(spark, "x", w, new_w, align_corners)
    met = grid.join(F.broadcast(ys), "y").join(F.broadcast(xs), "x")
    return met.groupBy(*FRAME, "y_t", "x_t").agg(F.sum(F.col(value) * F.col("wy") * F.col("wx")).alias(value)).select(*FRAME, F.col("y_t").alias("y"), F.col("x_t").alias("x"), value)


def bilinear_columns(grid: DataFrame, h: int, w: int, new_h: int, new_w: int, values: tuple[str, ...], keys: tuple[str, ...] = tuple(FRAME)) -> DataFrame:
    """keys, y, x and each of ``values``, resized as bilinear does in one pass."""
    spark = grid.sparkSession
    met = grid.join(F.broadcast(axis_weights(spark, "y", h, new_h)), "y").join(F.broadcast(axis_weights(spark, "x", w, new_w)), "x")
    sums = [F.sum(F.col(v) * F.col("wy") * F.col("wx")).alias(v) for v in values]
    return met.groupBy(*keys, F.col("y_t").alias("y"), F.col("x_t").alias("x")).agg(*sums)


def nearest(grid: DataFrame, h: int, w: int, new_h: int, new_w: int, value: str = "depth") -> DataFrame:
    """Each target takes the source at floor(target * source size / target size)."""
    spark = grid.sparkSession
    ys = spark.createDataFrame([(t * h // new_h, t) for t in range(new_h)], "y int, y_t int")
    xs = spark.createDataFrame([(t * w // new_w, t) for t in range(new_w)], "x int, x_t int")
    met = grid.join(F.broadcast(ys), "y").join(F.broadcast(xs), "x")
    return met.select(*FRAME, F.col("y_t").alias("y"), F.col("x_t").alias("x"), value)


def area(grid: DataFrame, factor: int, value: str = "depth") -> DataFrame:
    """Mean of each factor x factor block."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return grid.groupBy(*FRAME, block("y"), block("x")).agg(F.avg(value).alias(value))


def pyramid(grid: DataFrame, factors: tuple[int, ...] = (2, 4, 8), value: str = "depth") -> DataFrame:
    """factor, video, frame, y, x, value: nearest reductions by each factor in one pass."""
    each = grid.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    each = each.filter((F.col("y") % F.col("factor") == 0) & (F.col("x") % F.col("factor") == 0))
    return each.select("factor", *FRAME, (F.col("y") / F.col("factor")).cast("int").alias("y"), (F.col("x") / F.col("factor")).cast("int").alias("x"), value)


def sample(grid: DataFrame, places: DataFrame, h: int, w: int, padding: str = "zeros", value: str = "depth") -> DataFrame:
    """Add sampled to places (video, frame, id, u, v): bilinear value at u, v; beyond the edges 0, or the edge itself with ``border``."""
    u, v = F.col("u"), F.col("v")
    if padding == "border":
        u, v = F.least(F.greatest(u, F.lit(0.0)), F.lit(w - 1.0)), F.least(F.greatest(v, F.lit(0.0)), F.lit(h - 1.0))
    at = places.withColumn("_u", u).withColumn("_v", v)
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    four = at.withColumn("_c", F.explode(corners))
    fu, fv = F.col("_u") - F.floor("_u"), F.col("_v") - F.floor("_v")
    weight = F.when(F.col("_c.i") == 1, fu).otherwise(1 - fu) * F.when(F.col("_c.j") == 1, fv).otherwise(1 - fv)
    four = four.withColumn("x", (F.floor("_u") + F.col("_c.i")).cast("int")).withColumn("y", (F.floor("_v") + F.col("_c.j")).cast("int")).withColumn("_w", weight)
    met = four.join(grid.select(*FRAME, "y", "x", value), [*FRAME, "y", "x"], "left")
    return met.groupBy(*FRAME, "id", "u", "v").agg(F.sum(F.coalesce(value, F.lit(0.0)) * F.col("_w")).alias("sampled"))


def _cubic(at: np.ndarray, a: float = -0.75) -> np.ndarray:
    at = np.abs(at)
    return np.where(at <= 1, (a + 2) * at**3 - (a + 3) * at**2 + 1, np.where(at < 2, a * at**3 - 5 * a * at**2 + 8 * a * at - 4 * a, 0))


def _lanczos(at: np.ndarray, lobes: int = 3) -> np.ndarray:
    return np.where(np.abs(at) < lobes, np.sinc(at) * np.sinc(at / lobes), 0)


def resample_matrix(source: int, target: int, kernel: str) -> np.ndarray:
    """Weights of a separable kernel, target x source, edges repeated, rows summing to one."""
    f, reach = {"bicubic": (_cubic, 2), "lanczos": (_lanczos, 3)}[kernel]
    out = np.zeros((target, source))
    for t in range(target):
        at = (t + 0.5) * source / target - 0.5
        for i in range(int(np.floor(at)) - reach + 1, int(np.floor(at)) + reach + 1):
            out[t, min(max(i, 0), source - 1)] += f(np.array(at - i))
    return out / out.sum(axis=1, keepdims=True)


def resample(grid: DataFrame, h: int, w: int, new_h: int, new_w: int, kernel: str = "bicubic", value: str = "depth") -> DataFrame:
    """video, frame, y, x, value of a dense grid resized by a bicubic or Lanczos kernel, along x and then along y.

    The weight tables are as long as an edge, by at most six, and go out by broadcast.
    """
    spark = grid.sparkSession
    for axis, source, target in (("x", w, new_w), ("y", h, new_h)):
        matrix, other = resample_matrix(source, target, kernel), "y" if axis == "x" else "x"
        weights = spark.createDataFrame([(int(i), int(t), float(matrix[t, i])) for t, i in zip(*np.nonzero(matrix), strict=True)], f"{axis} int, _t int, _w double")
        met = grid.select(*FRAME, "y", "x", value).join(F.broadcast(weights), axis)
        grid = met.groupBy(*FRAME, other, F.col("_t").alias(axis)).agg(F.sum(F.col(value) * F.col("_w")).alias(value))
    return grid.select(*FRAME, "y", "x", value)


def aspect_size(h: Column, w: Column, long_edge: int = 518, multiple: int = 14) -> tuple[Column, Column]:
    """Size with the longer edge about ``long_edge``, both edges multiples, at least one multiple long."""
    scale = F.lit(float(long_edge)) / F.greatest(h, w)
    return tuple(F.greatest(F.rint(v * scale / multiple).cast("int") * multiple, F.lit(multiple)) for v in (h, w))


def low_width(h: Column, w: Column, low_h: int) -> Column:
    """Even width at height ``low_h``."""
    v = F.rint(w * low_h / h).cast("int")
    return v - v % 2


def low_disparity(disparity: Column | float, w: Column, low_w: Column) -> Column:
    """A disparity in pixels of the original width, in pixels of the low one."""
    return low_w * disparity / w


def shrunk_input_size(h: Column, w: Column, size: int = 518) -> Column:
    """Input size, less for images of an aspect over 1.78."""
    ratio = F.greatest(h, w) / F.least(h, w)
    return F.when(ratio > 1.78, F.rint((size * 1.777 / ratio).cast("int") / 14).cast("int") * 14).otherwise(size)


def solved_size(h: Column, w: Column, target_h: int, target_w: int, method: str = "lower_bound", multiple: int = 14) -> tuple[Column, Column]:
    """Size that keeps the aspect: ``lower_bound`` covers the target, ``upper_bound`` fits in it, ``minimal`` changes least."""
    sh, sw = F.lit(float(target_h)) / h, F.lit(float(target_w)) / w
    if method == "lower_bound":
        scale = F.greatest(sh, sw)
    elif method == "upper_bound":
        scale = F.least(sh, sw)
    elif method == "minimal":
        scale = F.when(F.abs(1 - sw) < F.abs(1 - sh), sw).otherwise(sh)
    else:
        raise ValueError(f"unknown method {method}")
    out = []
    for v, target in ((h, target_h), (w, target_w)):
        length = scale * v
        near = F.rint(length / multiple).cast("int") * multiple
        if method == "lower_bound":
            near = F.when(near < target, F.ceil(length / multiple).cast("int") * multiple).otherwise(near)
        elif method == "upper_bound":
            near = F.when(near > target, F.floor(length / multiple).cast("int") * multiple).otherwise(near)
        out.append(near)
    return tuple(out)
