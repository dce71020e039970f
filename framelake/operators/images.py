"""Channels, colour tables, grids, neighbourhoods and gates on pixel rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import clamp
from framelake.operators.frames import FRAME, dense_grid, last_writer, minmax_normalise, sequential_inpaint, with_holes
from framelake.operators.resize import bilinear_columns

# The eleven anchor colours of the diverging Spectral scheme, red to blue.
SPECTRAL = (
    (158, 1, 66), (213, 62, 79), (244, 109, 67), (253, 174, 97), (254, 224, 139), (255, 255, 191),
    (230, 245, 152), (171, 221, 164), (102, 194, 165), (50, 136, 189), (94, 79, 162),
)


def from_bgr(px: DataFrame) -> DataFrame:
    """Columns r, g, b in [0, 1] of pixels whose three channels 0 to 255 come blue first."""
    return px.select(*FRAME, "y", "x", (F.col("b") / 255.0).alias("r"), (F.col("g") / 255.0).alias("g"), (F.col("r") / 255.0).alias("b"))


def gray(px: DataFrame, level: Column) -> DataFrame:
    """The same value in three channels."""
    return px.select(*FRAME, "y", "x", *[level.alias(c) for c in "rgb"])


def colour_table(spark: SparkSession, name: str = "spectral") -> DataFrame:
    """level, cr, cg, cb of 256 levels, colours in [0, 1] between the scheme's anchors; ``spectral_r`` and ``gray`` as well."""
    at = np.arange(256) / 255.0
    if name == "gray":
        rows = np.stack([at] * 3, axis=1)
    elif name in ("spectral", "spectral_r"):
        anchors = np.array(SPECTRAL if name == "spectral" else SPECTRAL[::-1]) / 255.0
        rows = np.stack([np.interp(at, np.linspace(0, 1, len(anchors)), anchors[:, c]) for c in range(3)], axis=1)
    else:
        raise ValueError(f"unknown colour table {name}")
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "level int, cr double, cg double, cb double")


def coloured(px: DataFrame, table: DataFrame, level: str = "level") -> DataFrame:
    """Colours of a level of 0 to 255. The table has 256 rows and goes out by broadcast."""
    return px.join(F.broadcast(table), level).select(*FRAME, "y", "x", F.col("cr").alias("r"), F.col("cg").alias("g"), F.col("cb").alias("b"))


def output_levels(px: DataFrame, value: str) -> DataFrame:
    """Add level, 0 to 255: an image whose values don't exceed 1 is stretched by 255, any other is taken as it is."""
    top = px.groupBy(*FRAME).agg((F.max(value) <= 1).alias("_unit"))
    scaled = F.when(F.col("_unit"), F.col(value) * 255.0).otherwise(F.col(value))
    return px.join(top, list(FRAME)).withColumn("level", F.rint(clamp(scaled, 0.0, 255.0)).cast("int")).drop("_unit")


def channels_first(interleaved: Column, channels: int = 3) -> Column:
    """An array of pixels' channels as one array per channel, laid end to end."""
    one = lambda c: F.filter(interleaved, lambda _, i: i % channels == c)
    return F.concat(*[one(c) for c in range(channels)])


def pixel_grid(px: DataFrame, h: int, w: int) -> DataFrame:
    """video, frame, y, x and homogeneous coordinates gx, gy, gz, gw of every cell of each frame."""
    one = F.lit(1.0)
    return dense_grid(px, h, w).select(*FRAME, "y", "x", F.col("x").cast("double").alias("gx"), F.col("y").cast("double").alias("gy"), one.alias("gz"), one.alias("gw"))


def flipped(px: DataFrame, w: int) -> DataFrame:
    return px.withColumn("x", (w - 1 - F.col("x")).cast("int"))


def rolled(rows: DataFrame, n: int, by: int = 1, index: str = "frame") -> DataFrame:
    """Each view takes the place ``by`` before its own, the first ones the last places."""
    return rows.withColumn(index, F.pmod(F.col(index) - by, F.lit(n)))


def trimmed_right(px: DataFrame, by: int, h: int, w: int, mode: str, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Ragged edges of a warped view. ``crop``: the last ``by`` rows and columns go. ``blank``: the corner block of both becomes 0."""
    if mode == "crop":
        return px.filter((F.col("y") < h - by) & (F.col("x") < w - by))
    if mode != "blank":
        raise ValueError(f"unknown mode {mode}")
    corner = (F.col("y") >= h - by) & (F.col("x") >= w - by)
    return px.withColumns({c: F.when(corner, 0.0).otherwise(F.col(c)) for c in channels})


def trimmed_pair(left: DataFrame, right: DataFrame, by: int, h: int, w: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """video, frame, eye, y, x, channels: the dense grids of both eyes without their last ``by`` rows and columns, back at (h, w)."""
    eyes = left.select(*FRAME, "y", "x", *channels, F.lit("left").alias("eye")).unionByName(right.select(*FRAME, "y", "x", *channels, F.lit("right").alias("eye")))
    return bilinear_columns(trimmed_right(eyes, by, h, w, "crop"), h - by, w - by, h, w, channels, (*FRAME, "eye"))


def centre_cropped(grid: DataFrame, h: int, w: int, multiple: int = 8) -> tuple[DataFrame, int, int]:
    """The middle of a grid with edges that are multiples, moved to the origin, and where it began (y, x)."""
    new_h, new_w = h // multiple * multiple, w // multiple * multiple
    top, left = (h - new_h) // 2, (w - new_w) // 2
    inside = F.col("y").between(top, top + new_h - 1) & F.col("x").between(left, left + new_w - 1)
    return grid.filter(inside).withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left), top, left


def padded_back(cropped: DataFrame, h: int, w: int, new_h: int, new_w: int, top: int, left: int, mode: str = "replicate", value: str = "depth") -> DataFrame:
    """Undo centre_cropped on (new_h, new_w) pixels: beyond them the nearest edge, or 0 with ``constant``."""
    cells = dense_grid(cropped, h, w)
    y, x = F.col("y") - top, F.col("x") - left
    near = cells.withColumn("_y", F.least(F.greatest(y, F.lit(0)), F.lit(new_h - 1))).withColumn("_x", F.least(F.greatest(x, F.lit(0)), F.lit(new_w - 1)))
    source = cropped.select(*FRAME, F.col("y").alias("_y"), F.col("x").alias("_x"), value)
    out = near.join(source, [*FRAME, "_y", "_x"])
    if mode == "constant":
        out = out.withColumn(value, F.when((F.col("_y") == y) & (F.col("_x") == x), F.col(value)).otherwise(0.0))
    return out.select(*FRAME, "y", "x", value)


def confidence_gate(px: DataFrame, confidence: Column, least: float = 0.9, value: str = "depth") -> DataFrame:
    """0 where the confidence is below ``least``."""
    return px.withColumn(value, F.when(confidence < least, 0.0).otherwise(F.col(value)))


def mask_levels(grid: DataFrame, hole: str = "hole") -> DataFrame:
    """A mask as an image: 255 in it, 0 elsewhere."""
    return grid.select(*FRAME, "y", "x", F.when(F.col(hole), 255).otherwise(0).alias("level"))


def is_black(*channels: Column, most: float = -0.95) -> Column:
    """Whether all channels of a pixel in [-1, 1] lie at or below ``most``."""
    out = F.lit(True)
    for c in channels:
        out = out & (c <= most)
    return out


def inside_view(u: Column, v: Column) -> Column:
    """Whether normalised coordinates lie in [-1, 1] x [-1, 1]."""
    return u.between(-1.0, 1.0) & v.between(-1.0, 1.0)


def propagation_offsets(neighbours: int, dilation: int) -> list[tuple[int, int]]:
    """(dy, dx) around a pixel: 4 along the axes, 8 all around, 16 with the ring at twice the distance."""
    ring = [(y, x) for y in (-dilation, 0, dilation) for x in (-dilation, 0, dilation) if (y, x) != (0, 0)]
    if neighbours == 4:
        return [p for p in ring if 0 in p]
    if neighbours in (8, 16):
        return ring + [(2 * y, 2 * x) for y, x in ring if neighbours == 16]
    raise ValueError(f"{neighbours} neighbours are not offered")


def evaluation_offsets(neighbours: int, dilation: int) -> list[tuple[int, int]]:
    """The pixel itself and a ring one nearer than propagation's; 17 with the ring at twice its distance."""
    if neighbours not in (9, 17):
        raise ValueError(f"{neighbours} neighbours are not offered")
    return [(0, 0), *propagation_offsets(8 if neighbours == 9 else 16, dilation - 1)]


def with_neighbours(px: DataFrame, offsets: list[tuple[int, int]], value: str = "depth") -> DataFrame:
    """video, frame, y, x, near: values at the offsets, in ascending order, of every pixel; where there is none, nothing.

    Each pixel sends its value to the cells that look at it, so cells meet by an equality of keys, and only cells of ``px`` stay.
    """
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    sent = px.select(*FRAME, "y", "x", value, F.explode(table).alias("_o"))
    sent = sent.select(*FRAME, (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.dx")).alias("x"), value)
    near = sent.groupBy(*FRAME, "y", "x").agg(F.array_sort(F.collect_list(value)).alias("near"))
    return px.select(*FRAME, "y", "x").join(near, [*FRAME, "y", "x"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<double>")))


def refined(grid: DataFrame, residual: Column, least: float, most: float, value: str = "depth") -> DataFrame:
    """Twice the size: range scaled to [0, 1], each pixel four times, ``residual`` added, range restored."""
    two = F.sequence(F.lit(0), F.lit(1))
    up = grid.withColumn("_j", F.explode(two)).withColumn("_i", F.explode(two))
    scaled = (F.col(value) - least) / (most - least) + residual
    return up.select(*FRAME, (F.col("y") * 2 + F.col("_j")).alias("y"), (F.col("x") * 2 + F.col("_i")).alias("x"), (scaled * (most - least) + least).alias(value))


def baseline_stereo(px: DataFrame, h: int, w: int, deviation: int, kernel: int = 7) -> DataFrame:
    """The right view of the early pipeline: depth by its range, moved without a depth test, holes filled one after another."""
    moved = last_writer(minmax_normalise(px), deviation)
    return sequential_inpaint(with_holes(moved.filter(F.col("x") < w), h, w), h, w, kernel)
