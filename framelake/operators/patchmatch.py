"""Depth hypotheses from places between pixels: each pixel looks at offsets of its own, as a network would learn them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.poses import corner_cells

PIXEL = ["video", "frame", "y", "x"]


def looked_at(px: DataFrame, offsets: DataFrame, h: int, w: int, value: str = "depth") -> DataFrame:
    """video, frame, y, x, k, sampled: the value between four pixels at each pixel's k-th place.

    ``offsets`` has video, frame, y, x, k, dy, dx in pixels, fractions included. A place is scaled as
    normalised grids are whose ends are the outer edges of pixels:
    (x + dx) w / (w - 1) - 1/2, and then kept on the image, so that edges repeat. Pixels of ``px`` that are
    missing count as 0; a dense grid has none. Places meet their four pixels by one key.
    """
    on = lambda at, size: F.least(F.greatest(at * size / (size - 1) - 0.5, F.lit(0.0)), F.lit(float(size - 1)))
    at = offsets.select(*PIXEL, "k", on(F.col("y") + F.col("dy"), h).alias("_v"), on(F.col("x") + F.col("dx"), w).alias("_u"))
    # The last row and column belong to the cell before them, so all four corners exist.
    at = at.withColumn("row", F.least(F.floor("_v"), F.lit(h - 2)).cast("int")).withColumn("column", F.least(F.floor("_u"), F.lit(w - 2)).cast("int"))
    cells = corner_cells(px.select(*PIXEL, F.col(value).alias("z")))
    met = at.join(cells, ["video", "frame", "row", "column"], "left")
    fv, fu = F.col("_v") - F.col("row"), F.col("_u") - F.col("column")
    c = lambda i, j: F.coalesce(f"c{i}{j}", F.lit(0.0))
    sampled = (c(0, 0) * (1 - fu) + c(0, 1) * fu) * (1 - fv) + (c(1, 0) * (1 - fu) + c(1, 1) * fu) * fv
    return met.select(*PIXEL, "k", sampled.alias("sampled"))


def propagated(hypotheses: DataFrame, offsets: DataFrame, h: int, w: int) -> DataFrame:
    """video, frame, y, x, depths: each pixel's own hypotheses with the middle one of the places it looks at, in ascending order.

    ``hypotheses`` has video, frame, y, x and the array depths; its middle is the one at place size / 2, from 0.
    """
    middle = hypotheses.select(*PIXEL, F.get("depths", F.floor(F.size("depths") / 2).cast("int")).alias("depth"))
    near = looked_at(middle, offsets, h, w).groupBy(*PIXEL).agg(F.collect_list("sampled").alias("near"))
    met = hypotheses.select(*PIXEL, "depths").join(near, PIXEL, "left")
    return met.select(*PIXEL, F.array_sort(F.concat("depths", F.coalesce("near", F.array().cast("array<double>")))).alias("depths"))


def inverse_share(depth: Column, least: Column, most: Column) -> Column:
    """Inverse depth as its share of the inverse range: 0 at the greatest depth, 1 at the least."""
    return (1 / depth - 1 / most) / (1 / least - 1 / most)


def neighbour_weights(px: DataFrame, offsets: DataFrame, h: int, w: int, least: float, most: float, interval: float, value: str = "depth") -> DataFrame:
    """video, frame, y, x, k, weight: how near a pixel's inverse depth is to that of the k-th place it looks at.

    Shares of the inverse range are compared, not depths; a difference of 4 times ``interval``
    or more weighs least. Places are sampled among the shares.
    """
    shares = px.select(*PIXEL, inverse_share(F.col(value), F.lit(least), F.lit(most)).alias("share"))
    near = looked_at(shares, offsets, h, w, "share").join(shares, PIXEL)
    far = F.least(F.abs(F.col("sampled") - F.col("share")) / interval, F.lit(4.0))
    return near.select(*PIXEL, "k", (1 / (1 + F.exp(-2 * (2 - far)))).alias("weight"))
