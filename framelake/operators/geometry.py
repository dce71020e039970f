"""Cameras: unprojection, projection, reprojection, plane sweeps and splats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-2
#: Depth that stands for an invalid projection.
INVALID = -10.0


def unproject(x: Column, y: Column, z: Column, w: int, h: int, focal: float) -> tuple[Column, Column, Column]:
    """Camera coordinates of a pixel, its centre of projection in the middle of the image."""
    return (x - w / 2) / focal * z, (y - h / 2) / focal * z, z


def project(x: Column, y: Column, z: Column, w: int, h: int, focal: float) -> tuple[Column, Column]:
    """Pixel coordinates of a camera point; -10 where its depth is about 0."""
    near = F.abs(z) < EPS
    return F.when(near, INVALID).otherwise(F.try_divide(x, z) * focal + w / 2), F.when(near, INVALID).otherwise(F.try_divide(y, z) * focal + h / 2)


def transform_point(m: list[Column], x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """A point through a row-major 4 x 4 matrix."""
    return tuple(m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3))


def invert_pose(m: list[Column]) -> list[Column]:
    """Inverse of a rigid 4 x 4 matrix: transposed rotation, and the translation turned back."""
    r = [[m[4 * j + i] for j in range(3)] for i in range(3)]
    t = [-(r[i][0] * m[3] + r[i][1] * m[7] + r[i][2] * m[11]) for i in range(3)]
    return [*r[0], t[0], *r[1], t[1], *r[2], t[2], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def invert_matrix(m: list[Column]) -> Column:
    """Inverse of any row-major 4 x 4 matrix, an array of 16, from the minors of its upper and lower half; nulls where it has none."""
    two = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    minor = lambda top, p: m[4 * top + p[0]] * m[4 * top + 4 + p[1]] - m[4 * top + p[1]] * m[4 * top + 4 + p[0]]
    upper, lower = {p: minor(0, p) for p in two}, {p: minor(2, p) for p in two}
    rest = lambda p: tuple(i for i in range(4) if i not in p)
    sign = lambda p: -1.0 if (p[0] + p[1]) % 2 == 0 else 1.0
    det = sum((upper[p] * lower[rest(p)] * sign(p) for p in two), F.lit(0.0))

    def cofactor(row: int, column: int) -> Column:
        """Signed determinant of what stays without a row and a column: the other row of its half against minors of the other half."""
        partner, minors = row ^ 1, lower if row < 2 else upper
        left = [c for c in range(4) if c != column]
        terms = [m[4 * partner + c] * minors[tuple(k for k in left if k != c)] * float((-1) ** i) for i, c in enumerate(left)]
        # The partner is the first or the last of the three rows: an even number of swaps apart.
        return (terms[0] + terms[1] + terms[2]) * float((-1) ** (row + column))

    # As one array, so that the determinant is taken once and not for each entry.
    return F.flatten(F.transform(F.array(det), lambda d: F.array(*[F.try_divide(cofactor(j, i), d) for i in range(4) for j in range(4)])))


def invert_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column, Column]:
    """Focal lengths and centre of the inverse intrinsic matrix."""
    return 1 / fx, 1 / fy, -cx / fx, -cy / fy


def plane_sweep(x: Column, y: Column, z: Column, w: int, h: int) -> tuple[Column, Column]:
    """Sampling coordinates of a warped point; points behind the camera go to the far corner."""
    behind = z <= 1e-3
    return F.when(behind, float(w)).otherwise(F.try_divide(x, z)), F.when(behind, float(h)).otherwise(F.try_divide(y, z))


def view_direction_change(a: list[Column], b: list[Column]) -> list[Column]:
    """Difference of two viewing directions as a unit vector, and their cosine."""
    length = lambda v: F.greatest(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(1e-6))
    u, v = [c / length(a) for c in a], [c / length(b) for c in b]
    d = [p - q for p, q in zip(u, v, strict=True)]
    return [*[c / length(d) for c in d], u[0] * v[0] + u[1] * v[1] + u[2] * v[2]]


def geometry_feature(z: Column, least: float) -> Column:
    """Inverse depth over the greatest inverse depth, in [-1, 1]."""
    return (1 / z) / (1 / least) * 2 - 1


def depth_weight(difference: Column, scale: float) -> Column:
    return 1 / (1 + F.exp(-2 * (2 - F.least(F.abs(difference) / scale, F.lit(4.0)))))


def reproject(px: DataFrame, step: int, w: int, h: int, focal: float, move: tuple[float, float, float]) -> DataFrame:
    """video, frame, y, x, z: pixels of each frame seen from the frame ``step`` later, whose camera has moved by ``step`` times ``move``.

    Coordinates round half to even; of pixels that land together the one with the larger index stays.
    """
    cx, cy, cz = unproject(F.col("x"), F.col("y"), F.col("z"), w, h, focal)
    there = px.select("video", (F.col("frame") + step).alias("frame"), (F.col("y") * w + F.col("x")).alias("src"), *[(c - step * m).alias(n) for c, m, n in zip((cx, cy, cz), move, ("px", "py", "pz"), strict=True)])
    u, v = project(F.col("px"), F.col("py"), F.col("pz"), w, h, focal)
    there = there.withColumn("u", F.rint(u).cast("int")).withColumn("v", F.rint(v).cast("int"))
    there = there.filter((F.col("u") >= 0) & (F.col("u") < w) & (F.col("v") >= 0) & (F.col("v") < h))
    best = there.groupBy("video", "frame", "v", "u").agg(F.max(F.struct("src", "pz")).alias("best"))
    return best.select("video", "frame", F.col("v").alias("y"), F.col("u").alias("x"), F.col("best.pz").alias("z"))


def splat(points: DataFrame, w: int, h: int, radius: int = 1, nearest: int = 4, tau: float = 1.0, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """keys, y, x, wsum, wsumnorm, composite, depth: up to ``nearest`` points around each pixel, blended.

    A point with sub-pixel place (u, v), depth z and value reaches the pixels
    within ``radius``; its weight falls with the squared distance over the
    squared radius. composite lets each point cover those behind it.
    """
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    near = points.withColumn("dy", F.explode(reach)).withColumn("dx", F.explode(reach))
    near = near.withColumn("y", (F.rint("v") + F.col("dy")).cast("int")).withColumn("x", (F.rint("u") + F.col("dx")).cast("int"))
    d2 = ((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))) / float(radius * radius)
    near = near.withColumn("d", d2).filter((F.col("d") <= 1) & F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    order = Window.partitionBy(*keys, "y", "x").orderBy("z", "src")
    alpha = F.pow(1 - F.sqrt(F.least(F.greatest(F.col("d"), F.lit(1e-3)), F.lit(1.0))), F.lit(tau))
    top = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).withColumn("alpha", alpha)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A point that covers all lets nothing through: its log is kept at the least double.
    through = F.coalesce(F.exp(F.sum(F.log(F.greatest(1 - F.col("alpha"), F.lit(1e-300)))).over(before)), F.lit(1.0))
    top = top.withColumn("visible", F.col("alpha") * through)
    return top.groupBy(*keys, "y", "x").agg(
        F.sum(F.col("alpha") * F.col("value")).alias("wsum"),
        F.coalesce(F.try_divide(F.sum(F.col("alpha") * F.col("value")), F.sum("alpha")), F.lit(0.0)).alias("wsumnorm"),
        F.sum(F.col("visible") * F.col("value")).alias("composite"),
        F.coalesce(F.try_divide(F.sum(F.col("alpha") * F.col("z")), F.sum("alpha")), F.lit(0.0)).alias("depth"),
    )


def identity_unproject(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Camera coordinates under the identity projection."""
    return x * z, y * z, z


def stage_intrinsics(cameras: DataFrame, start_x: Column, start_y: Column, stages: int = 4) -> DataFrame:
    """stage, fx, fy, cx, cy besides the other columns: the crop's start leaves the centre, then every stage halves all four."""
    others = [c for c in cameras.columns if c not in ("fx", "fy", "cx", "cy")]
    each = cameras.withColumn("stage", F.explode(F.sequence(F.lit(0), F.lit(stages - 1)))).withColumn("_f", F.pow(F.lit(0.5), F.col("stage")))
    return each.select(*others, "stage", (F.col("fx") * F.col("_f")).alias("fx"), (F.col("fy") * F.col("_f")).alias("fy"), ((F.col("cx") - start_x) * F.col("_f")).alias("cx"), ((F.col("cy") - start_y) * F.col("_f")).alias("cy"))


def mean_intrinsics(cameras: DataFrame, keys: list[str]) -> DataFrame:
    """One camera per sample: the mean of its views'."""
    return cameras.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("fx", "fy", "cx", "cy")])


def depth_hypotheses(least: Column, most: Column, jitter: Column, bins: int = 48) -> Column:
    """Array of depths, one in each of ``bins`` equal parts of the inverse range; ``jitter`` in [0, 1) is the place inside a part."""
    far, near = 1 / most, 1 / least
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: 1 / (far + (k + jitter) / float(bins) * (near - far)))


def perturbed_hypotheses(depth: Column, least: Column, most: Column, share: float, samples: int) -> Column:
    """Array of depths around one: steps of ``share`` of the inverse range, from -samples / 2, rounded down, on, kept inside it."""
    far, near = 1 / most, 1 / least
    steps = F.sequence(F.lit((-samples) // 2), F.lit((-samples) // 2 + samples - 1))
    return F.transform(steps, lambda k: 1 / F.least(F.greatest(1 / depth + (near - far) * share * k, far), near))
