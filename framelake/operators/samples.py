"""Samples of several views: which images, in which order, with which cameras, masks and boxes, one row per view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.geometry import invert_matrix
from framelake.operators.poses import entries


def share_of(*parts: Column | str) -> Column:
    """A number in [0, 1) that parts keep in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / (1 << 32)


def lit_images(files: DataFrame, keys: list[str], lights: list[str], seed: str = "light") -> DataFrame:
    """keys, path, light, place: each sample's images under the one of ``lights`` that it draws, numbered in order of path.

    ``files`` has keys and path; an image's light is the end of its name, before .jpg or .png.
    """
    drawn = F.element_at(F.array(*[F.lit(x) for x in lights]), (F.floor(share_of(F.lit(seed), *keys) * len(lights)) + 1).cast("int"))
    ends = lambda kind: F.endswith("path", F.concat("light", F.lit(kind)))
    lit = files.select(*keys, "path").withColumn("light", drawn).filter(ends(".jpg") | ends(".png"))
    return lit.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("path")) - 1)


def drawn_views(views: DataFrame, keys: list[str], n: int, inputs: int, reuse: float = 0.0, seed: str = "views") -> DataFrame:
    """views with slot: ``n`` of each sample's places at random, the first ``inputs`` of them for input.

    Draws depend on the sample's keys and the place, so samples differ and reruns
    agree. Each of the targets that follow the inputs, as many as there are
    inputs, is the input in its order instead with probability ``reuse``. A sample with
    fewer places has all of them.
    """
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(seed), *keys, "place").cast("binary")), "place")
    drawn = views.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < n)
    if not reuse:
        return drawn
    last = min(2 * inputs, n)
    slots = drawn.select(*keys, "slot")
    given = (F.col("slot") >= inputs) & (F.col("slot") < last) & (share_of(F.lit(f"{seed} reuse"), *keys, (F.col("slot") - inputs).cast("string")) <= reuse)
    source = slots.select(*keys, F.col("slot").alias("_to"), F.when(given, F.col("slot") - inputs).otherwise(F.col("slot")).alias("slot"))
    return source.join(drawn, [*keys, "slot"]).drop("slot").withColumnRenamed("_to", "slot")


def fixed_views(views: DataFrame, keys: list[str], first: list[int]) -> DataFrame:
    """views with slot: the places ``first``, in that order, then all others in theirs; as for tests. Places that a sample lacks are left out."""
    rank = F.array_position(F.array(*[F.lit(i) for i in first]), F.col("place").cast("int"))
    order = Window.partitionBy(*keys).orderBy(F.when(rank > 0, rank).otherwise(F.lit(len(first) + 1)), "place")
    return views.withColumn("slot", F.row_number().over(order) - 1)


def with_cameras(views: DataFrame, cameras: DataFrame, keys: list[str], on: list[str], scale: float = 1.0, resized: float = 1.0, invert_resized: bool = True) -> DataFrame:
    """views with pose, pose_inverse, k and k_inverse, 4 x 4 matrices by row.

    ``cameras`` has the columns ``on``, rotation (9), translation (3) and
    intrinsics (9). A pose is the rotation with the translation over ``scale``. The
    intrinsics are the mean of focal lengths and centres over the sample's views,
    one that is there twice counting twice; k has them times ``resized``, the image's new height over its own,
    and k_inverse is the inverse of k, or of what it was before that.
    """
    at = lambda c, i: F.get(c, F.lit(i))
    zero, one = F.lit(0.0), F.lit(1.0)
    met = views.join(cameras.select(*on, "rotation", "translation", "intrinsics"), on)
    rows = [x for i in range(3) for x in (*(at("rotation", 3 * i + j) for j in range(3)), at("translation", i) / scale)]
    posed = met.withColumn("pose", F.array(*rows, zero, zero, zero, one))
    means = {"fx": 0, "fy": 4, "cx": 2, "cy": 5}
    shared = posed.groupBy(*keys).agg(*[F.avg(at("intrinsics", i)).alias(f"_{c}") for c, i in means.items()])

    def matrix(by: float) -> Column:
        fx, fy, cx, cy = (F.col(f"_{c}") * by for c in means)
        return F.array(fx, zero, cx, zero, zero, fy, cy, zero, zero, zero, one, zero, zero, zero, zero, one)

    def inverse_of(by: float) -> Column:
        fx, fy, cx, cy = (F.col(f"_{c}") * by for c in means)
        return F.array(1 / fx, zero, -cx / fx, zero, zero, 1 / fy, -cy / fy, zero, zero, zero, one, zero, zero, zero, zero, one)

    out = posed.join(shared, keys)
    kept = [c for c in views.columns if c != "pose"]
    return out.select(*kept, "pose", invert_matrix(entries(F.col("pose"))).alias("pose_inverse"), matrix(resized).alias("k"), inverse_of(resized if invert_resized else 1.0).alias("k_inverse"))


def mask_boxes(px: DataFrame, keys: list[str], mask: Column, resized: float = 1.0) -> DataFrame:
    """keys, box: (first column, first row, last column, last row) of each view's mask, times ``resized``; raises where a view's mask is empty."""
    edges = [(F.min, "x"), (F.min, "y"), (F.max, "x"), (F.max, "y")]
    found = px.groupBy(*keys).agg(*[f(F.when(mask, F.col(c))).alias(f"_{i}") for i, (f, c) in enumerate(edges)])
    box = F.array(*[F.col(f"_{i}") * resized for i in range(4)])
    bad = F.raise_error(F.concat(F.lit("empty mask of view "), F.concat_ws("/", *keys)))
    return found.select(*keys, F.when(F.col("_0").isNotNull(), box).otherwise(bad.cast("array<double>")).alias("box"))


def black_mask(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), below: float = -0.95) -> DataFrame:
    """px with mask: not black, that is not every channel, in [-1, 1], at the limit or below."""
    return px.withColumn("mask", ~reduce(lambda a, b: a & b, [F.col(c) <= below for c in channels]))
