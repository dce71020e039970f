"""Raster operators against hand-computed values and numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framelake import functions as fn
from framelake.operators import frames as fr
from framelake.operators import resize as rs


def raster(spark, rows, names, video="v"):
    h, w = np.array(rows[0]).shape
    out = [(video, 0, y, x, *[float(r[y][x]) for r in rows]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(out, "video string, frame long, y int, x int, " + ", ".join(f"{n} double" for n in names))


def grid_of(df, value, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[value] is None else r[value]
    return out


def test_packed_zbuffer_by_hand(spark):
    near = [[0.25, 0.25, 0, 1, 0, 0.5]]
    px = raster(spark, [near, [[10, 11, 12, 13, 14, 15]]], ["near", "r"]).withColumn("disparity", F.col("near") * 2)
    got = {r.x: r.src for r in fr.zbuffer_packed(px, 1, 6, ("r",)).collect()}
    assert got == {0: 1, 1: 3, 2: 2, 4: 5}
    assert {r.x: r.src for r in fr.zbuffer_struct(px, 6, ("r",)).collect()} == got
    holes = fr.with_holes(fr.zbuffer_packed(px, 1, 6, ("r",)), 1, 6, ("r",)).filter("hole")
    assert sorted(r.x for r in holes.collect()) == [3, 5]


def test_zbuffer_does_not_depend_on_row_order(spark):
    rng = np.random.default_rng(4)
    px = raster(spark, [rng.random((6, 9)).round(1), rng.random((6, 9))], ["near", "r"]).withColumn("disparity", F.col("near") * 4)
    a, b = (sorted(map(tuple, fr.zbuffer_packed(p, 6, 9, ("r",)).collect())) for p in (px, px.orderBy(F.rand(1))))
    assert a == b
    written = fr.zbuffer_packed(px, 6, 9, ("r",))
    holes = fr.with_holes(written, 6, 9, ("r",)).filter("hole").count()
    assert holes + written.count() == 54


def test_quantile_normalise_by_hand(spark):
    px = raster(spark, [[[1, 2, 3, 4, 100]]], ["depth"])
    bounds = fr.quantile_bounds(px).first()
    assert np.allclose([bounds.lo, bounds.hi], [1.04, 96.16])
    got = grid_of(fr.quantile_normalise(px), "norm", 1, 5)[0]
    assert np.allclose(got, [0, 0.010093, 0.020606, 0.031119, 1], atol=1e-6)


def test_flat_frame(spark):
    px = raster(spark, [[[5, 5], [5, 5]]], ["depth"])
    assert (grid_of(fr.minmax_normalise(px), "norm", 2, 2) == 0).all()
    assert (grid_of(fr.bit_depth(px, 8), "level", 2, 2) == 0).all()
    assert (grid_of(fr.quantile_normalise(px), "norm", 2, 2) == 0).all()


def test_dilate_by_hand(spark):
    px = raster(spark, [[[0, 0, 0, 1, 0, 0, 1, 0]]], ["m"]).withColumn("hole", F.col("m") == 1)
    got = grid_of(fr.dilate_left(px, 2, 8).withColumn("h", F.col("hole").cast("int")), "h", 1, 8)[0]
    assert got.tolist() == [0, 1, 1, 1, 1, 1, 1, 0]


def test_compat_inpaint_by_hand(spark):
    px = raster(spark, [[[5, 5, 0, 0, 0, 0, 0, 5]]], ["r"]).withColumn("hole", F.col("x").between(2, 6))
    assert grid_of(fr.box_inpaint(px, 3, ("r",)), "r", 1, 8)[0].tolist() == [5, 5, 5, 0, 0, 0, 5, 5]
    twice = grid_of(fr.box_inpaint(px, 3, ("r",), "iterative", 3), "r", 1, 8)[0]
    assert twice.tolist() == [5] * 8


def brute_sequential(image, hole, kernel):
    image, hole, half = image.copy(), hole.copy(), kernel // 2
    changed = True
    while changed:
        changed = False
        for y in range(image.shape[0]):
            for x in range(image.shape[1]):
                if hole[y, x]:
                    near = [(j, i) for j in range(y - half, y + half + 1) for i in range(x - half, x + half + 1) if 0 < j < image.shape[0] and 0 < i < image.shape[1] and not hole[j, i]]
                    if near:
                        image[y, x] = sum(image[j, i] for j, i in near) // len(near)
                        hole[y, x] = False
                        changed = True
    return image


def test_sequential_inpaint(spark):
    rng = np.random.default_rng(8)
    image, hole = rng.integers(0, 255, (9, 12)), rng.random((9, 12)) < 0.5
    want = brute_sequential(np.where(hole, 0, image), hole, 5)
    px = raster(spark, [image, image, image, hole], ["r", "g", "b", "m"]).withColumn("hole", F.col("m") == 1)
    px = px.select("video", "frame", "y", "x", *[F.when(~F.col("hole"), F.col(c)).alias(c) for c in "rgb"], "hole")
    assert (grid_of(fr.sequential_inpaint(px, 9, 12, 5), "g", 9, 12) == want).all()


def test_last_writer_and_painters(spark):
    px = raster(spark, [[[0, 0.5, 0, 0.99]], [[1, 2, 3, 4]]], ["norm", "r"])
    got = {r.x: r.src_x for r in fr.last_writer(px, 3, ("r",)).collect()}
    assert got == {0: 1, 2: 2, 1: 3}
    px = raster(spark, [[[3, 1, 2]], [[0, 1, 2]], [[7, 8, 9]]], ["z", "disparity", "r"])
    assert [(r.x, r.src) for r in fr.painters(px, 3, ("r",)).collect()] == [(0, 1)]


def test_layouts(spark):
    left, right = (raster(spark, [[[a, a]], [[a, a]], [[a, a]]], ["r", "g", "b"]) for a in (0.2, 0.8))
    assert fr.compose_stereo(left, right, "sbs", 1, 2).count() == 4
    assert {r.y for r in fr.compose_stereo(left, right, "ou", 1, 2).collect()} == {0, 1}
    first = fr.compose_stereo(left, right, "overlay", 1, 2, 2.0).first()
    assert first.r == 0.8
    assert tuple(fr.compose_stereo(left, right, "anaglyph", 1, 2).first())[4:] == (0.2, 0.8, 0.8)


def test_crop_from_the_far_side(spark):
    px = raster(spark, [np.zeros((6, 8))], ["depth"])
    assert fr.crop(px, 1, -1, 2, -2, 6, 8).count() == 16
    assert fr.crop(px, 0, 0, 0, 0, 6, 8).count() == 48


def test_size_rules(spark):
    sizes = spark.createDataFrame([(1080, 1920), (480, 640)], "h int, w int")
    h, w = rs.aspect_size(F.col("h"), F.col("w"))
    assert [tuple(r) for r in sizes.select(h, w).collect()] == [(294, 518), (392, 518)]


def bilinear_numpy(image, nh, nw, corners):
    h, w = image.shape
    def axis(n, s):
        t = np.arange(n)
        at = t * (s - 1) / (n - 1) if corners else np.maximum((t + 0.5) * s / n - 0.5, 0)
        lo = np.minimum(at.astype(int), s - 1)
        return lo, np.minimum(lo + 1, s - 1), at - lo
    y0, y1, fy = axis(nh, h)
    x0, x1, fx = axis(nw, w)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy)[:, None] + low * fy[:, None]


def test_resizes(spark):
    image = np.random.default_rng(1).random((6, 10))
    px = raster(spark, [image], ["depth"])
    for corners in (False, True):
        assert np.allclose(grid_of(rs.bilinear(px, 6, 10, 9, 4, corners), "depth", 9, 4), bilinear_numpy(image, 9, 4, corners))
    assert np.allclose(grid_of(rs.bilinear(px, 6, 10, 6, 10), "depth", 6, 10), image)
    assert np.allclose(grid_of(rs.area(px, 2), "depth", 3, 5), image.reshape(3, 2, 5, 2).mean(axis=(1, 3)))
    assert np.allclose(grid_of(rs.nearest(px, 6, 10, 3, 5), "depth", 3, 5), image[::2, ::2])
    for kernel in ("bicubic", "lanczos"):
        assert np.allclose(grid_of(rs.resample(px, 6, 10, 6, 10, kernel), "depth", 6, 10), image)
        flat = raster(spark, [np.ones((6, 10))], ["depth"])
        assert np.allclose(grid_of(rs.resample(flat, 6, 10, 4, 7, kernel), "depth", 4, 7), 1)


def test_sample_edges(spark):
    px = raster(spark, [[[1, 2], [3, 4]]], ["depth"])
    at = spark.createDataFrame([("v", 0, 1, 0.5, 0.5), ("v", 0, 2, -0.5, 0.0), ("v", 0, 3, 1.0, 1.0)], "video string, frame long, id long, u double, v double")
    zeros = {r.id: r.sampled for r in rs.sample(px, at, 2, 2).collect()}
    border = {r.id: r.sampled for r in rs.sample(px, at, 2, 2, "border").collect()}
    assert zeros == {1: 2.5, 2: 0.5, 3: 4.0} and border == {1: 2.5, 2: 1.0, 3: 4.0}


def test_rounding_is_half_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(F.rint("v")).collect()
    assert [r[0] for r in got] == [0, 2, 2]


def test_quantise_truncates(spark):
    got = spark.createDataFrame([(-1.0,), (0.999,), (1.0,), (7.0,)], "v double").select(fn.quantise(F.col("v")).alias("q")).collect()
    assert [r.q for r in got] == [0, 254, 255, 255]


def test_iou_and_box(spark):
    px = raster(spark, [[[1, 1, 0, 0]], [[0, 1, 1, 0]]], ["a", "b"])
    assert fr.mask_iou(px, F.col("a") == 1, F.col("b") == 1).first().iou == 1 / 3
    assert fr.mask_iou(px, F.col("a") == 9, F.col("b") == 9).first().iou is None
    assert tuple(fr.bounding_box(px, F.col("b") == 1).first())[2:] == (0, 0, 1, 2)


def test_empty_frames(spark):
    px = raster(spark, [[[1.0]], [[1.0]], [[1.0]], [[1.0]]], ["depth", "r", "g", "b"]).limit(0)
    assert fr.quantile_normalise(px).count() == 0
    assert fr.with_holes(px, 4, 4).count() == 0
    assert fr.box_inpaint(fr.with_holes(px, 4, 4)).count() == 0


def test_painted_frame_shape():
    image = fr.sequential_fill(np.zeros((3, 3, 3), dtype=int), np.ones((3, 3), dtype=bool))
    assert image.shape == (3, 3, 3) and isinstance(pd.DataFrame(image[:, :, 0]), pd.DataFrame)
