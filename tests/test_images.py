"""Channels, neighbourhoods, cameras and composite losses against hand-computed values and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import features as ft
from framelake.operators import frames as fr
from framelake.operators import geometry as geo
from framelake.operators import images as im
from framelake.operators import losses as ls
from framelake.operators import temporal as tp
from framelake.operators.conversion import to_stereo


def raster(spark, rows, names, frame=0):
    h, w = np.array(rows[0]).shape
    out = [("v", frame, y, x, *[float(r[y][x]) for r in rows]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(out, "video string, frame long, y int, x int, " + ", ".join(f"{n} double" for n in names))


def grid_of(df, value, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def test_channels(spark):
    px = raster(spark, [[[255]], [[51]], [[0]]], ["r", "g", "b"])
    row = im.from_bgr(px).first()
    assert (row.r, row.g, row.b) == (0.0, 0.2, 1.0)
    assert spark.range(1).select(im.channels_first(F.array(*[F.lit(i) for i in range(6)])).alias("c")).first().c == [0, 3, 1, 4, 2, 5]
    unit, whole = raster(spark, [[[0.5, 1.0]]], ["v"]), raster(spark, [[[0.5, 200.0]]], ["v"])
    assert grid_of(im.output_levels(unit, "v"), "level", 1, 2).tolist() == [[128, 255]]
    assert grid_of(im.output_levels(whole, "v"), "level", 1, 2).tolist() == [[0, 200]]


def test_colour_tables(spark):
    rows = im.colour_table(spark, "spectral_r").orderBy("level").collect()
    assert len(rows) == 256 and np.allclose([rows[0].cr * 255, rows[255].cb * 255], [94, 66])
    assert im.colour_table(spark, "gray").filter("level = 51").first().cg == 0.2
    with pytest.raises(ValueError, match="unknown colour table"):
        im.colour_table(spark, "nothing")


def test_edges(spark):
    image = np.arange(48.0).reshape(6, 8)
    px = raster(spark, [image], ["depth"])
    assert im.trimmed_right(px, 2, 6, 8, "crop", ("depth",)).count() == 24
    blank = grid_of(im.trimmed_right(px, 2, 6, 8, "blank", ("depth",)), "depth", 6, 8)
    assert blank[4:, 6:].sum() == 0 and blank.sum() == image.sum() - image[4:, 6:].sum()
    cropped, top, left = im.centre_cropped(px, 6, 8, 4)
    assert (top, left) == (1, 0) and np.array_equal(grid_of(cropped, "depth", 4, 8), image[1:5])
    assert np.array_equal(grid_of(im.padded_back(cropped, 6, 8, 4, 8, top, left), "depth", 6, 8), np.pad(image[1:5], ((1, 1), (0, 0)), mode="edge"))
    assert np.array_equal(grid_of(im.padded_back(cropped, 6, 8, 4, 8, top, left, "constant"), "depth", 6, 8), np.pad(image[1:5], ((1, 1), (0, 0))))
    assert np.array_equal(grid_of(im.flipped(px, 8), "depth", 6, 8), image[:, ::-1])


def test_roll_takes_the_place_before(spark):
    views = spark.createDataFrame([(i,) for i in range(4)], "frame long")
    assert [r.to for r in im.rolled(views.withColumn("was", F.col("frame")), 4).orderBy("was").select(F.col("frame").alias("to")).collect()] == [3, 0, 1, 2]


def test_offsets():
    assert im.propagation_offsets(4, 2) == [(-2, 0), (0, -2), (0, 2), (2, 0)]
    assert len(set(im.propagation_offsets(16, 2))) == 16 and (4, -4) in im.propagation_offsets(16, 2)
    assert len(set(im.evaluation_offsets(17, 3))) == 17 and max(map(max, im.evaluation_offsets(9, 3))) == 2
    with pytest.raises(ValueError):
        im.propagation_offsets(5, 1)


def test_neighbours(spark):
    image = np.random.default_rng(3).random((5, 6))
    px = raster(spark, [image], ["depth"])
    got = {(r.y, r.x): r.near for r in im.with_neighbours(px, im.propagation_offsets(8, 2)).collect()}
    for y in range(5):
        for x in range(6):
            want = sorted(image[j, i] for j in (y - 2, y, y + 2) for i in (x - 2, x, x + 2) if (j, i) != (y, x) and 0 <= j < 5 and 0 <= i < 6)
            assert got[y, x] == want
    alone = im.with_neighbours(px.filter("y = 0 AND x = 0"), [(1, 1)]).first()
    assert alone.near == [] and im.with_neighbours(px.limit(0), [(0, 1)]).count() == 0


def test_refined_doubles(spark):
    px = raster(spark, [[[1.0, 3.0]]], ["depth"])
    got = grid_of(im.refined(px, F.lit(0.25), 1.0, 5.0), "depth", 2, 4)
    assert got.tolist() == [[2, 2, 4, 4]] * 2


def test_baseline_stereo_fills_what_it_can(spark):
    rng = np.random.default_rng(5)
    px = raster(spark, [rng.random((8, 12)), *[rng.integers(1, 255, (8, 12)) for _ in range(3)]], ["depth", "r", "g", "b"])
    out = im.baseline_stereo(px, 8, 12, 3)
    assert out.count() == 96 and out.filter("r = 0").count() == 0
    flat = raster(spark, [np.ones((4, 4)), *[np.full((4, 4), 9)] * 3], ["depth", "r", "g", "b"])
    assert {r.r for r in im.baseline_stereo(flat, 4, 4, 3).collect()} == {9}


def test_hypotheses(spark):
    near, far = F.lit(2.0), F.lit(10.0)
    got = spark.range(1).select(geo.depth_hypotheses(near, far, F.lit(0.0)).alias("a"), geo.perturbed_hypotheses(F.lit(4.0), near, far, 1.0, 4).alias("b")).first()
    assert np.allclose(got.a, 1 / (0.1 + np.arange(48) / 48 * 0.4))
    assert np.allclose(got.b, 1 / np.clip(0.25 + 0.4 * np.arange(-2, 2), 0.1, 0.5))


def test_stage_intrinsics(spark):
    cameras = spark.createDataFrame([(1, 100.0, 80.0, 50.0, 40.0)], "id int, fx double, fy double, cx double, cy double")
    rows = geo.stage_intrinsics(cameras, F.lit(2), F.lit(0), 3).orderBy("stage").collect()
    assert [(r.fx, r.cx, r.cy) for r in rows] == [(100, 48, 40), (50, 24, 20), (25, 12, 10)]
    both = cameras.unionByName(cameras.withColumn("fx", F.lit(50.0)))
    assert geo.mean_intrinsics(both, ["id"]).first().fx == 75


def test_silog_loss(spark):
    rows = spark.createDataFrame([(0, 0, 2.0, 1.0), (0, 0, 4.0, 1.0)], "dataset int, scene int, pred double, gt double")
    d = -np.log([2, 4])
    assert math.isclose(ls.silog_loss(rows).first().loss, math.sqrt((d**2).mean() - 0.5 * d.mean() ** 2))


def clip(spark, pred, target):
    rows = [("v", f, y, x, float(pred[f, y, x]), float(target[f, y, x]), True) for f in range(len(pred)) for y in range(pred.shape[1]) for x in range(pred.shape[2])]
    return spark.createDataFrame(rows, "video string, frame int, y int, x int, pred double, target double, mask boolean")


def test_video_depth_loss(spark):
    rng = np.random.default_rng(7)
    target = rng.random((3, 4, 4))
    target[1:] = target[:1] + 0.001 * rng.random((2, 4, 4))
    same = ls.video_depth_loss(clip(spark, 3 * target + 2, target)).first()
    assert abs(same.spatial) < 1e-9 and abs(same.stable) < 1e-3
    pred = rng.random((3, 4, 4))
    row = ls.video_depth_loss(clip(spark, pred, target)).first()
    p, t = pred.ravel(), target.ravel()
    det = (p @ p) * p.size - p.sum() ** 2 + 1e-6
    fitted = (p.size * (p @ t) - p.sum() * t.sum()) / det * pred + (-p.sum() * (p @ t) + (p @ p) * t.sum()) / det
    dp, dt = np.diff(fitted, axis=0), np.diff(target, axis=0)
    still = np.abs(dt) < 0.05 * (target[1:].max(axis=(1, 2)) - target[1:].min(axis=(1, 2)))[:, None, None]
    assert math.isclose(row.stable, 10 * np.abs(dp - dt)[still].mean(), rel_tol=1e-9)
    spatial = []
    for f in range(3):
        n = []
        for m in (pred[f], target[f]):
            middle = np.sort(m.ravel())[7]
            n.append((m - middle) / np.abs(m - middle).mean())
        d = n[0] - n[1]
        smooth = sum((np.abs(np.diff(d[::s, ::s], axis=0)).sum() + np.abs(np.diff(d[::s, ::s], axis=1)).sum()) / d[::s, ::s].size for s in (1, 2, 4, 8))
        spatial.append(np.abs(d).mean() + 0.5 * smooth)
    assert math.isclose(row.spatial, np.mean(spatial), rel_tol=1e-9)


def test_combined_loss_leaves_the_first_unscaled(spark):
    rows = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert ls.combined(rows, ["7.0_a", "10.0_b"]).first().total == 32.0


def test_split_means(spark):
    rows = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 3.0), ("t", 1, 5.0)], "k string, frame int, m double")
    got = {r.k: (r.m_all, r.m_rest) for r in ls.split_means(rows, ("m",), F.col("frame") == 1, ("k",)).collect()}
    assert got == {"s": (2.0, 3.0), "t": (5.0, None)}


def test_array_statistics(spark):
    a, b = np.random.default_rng(1).normal(size=(2, 9))
    row = spark.createDataFrame([(a.tolist(), b.tolist(), [1.0])], "a array<double>, b array<double>, one array<double>")
    got = row.select(ft.deviation(F.col("a")).alias("d"), ft.rescaled_guidance(F.col("a"), F.col("b"), 0.7).alias("g"), ft.blended(F.col("a"), F.col("b")).alias("m"), ft.deviation(F.col("one")).alias("n")).first()
    assert math.isclose(got.d, a.std(ddof=1)) and np.allclose(got.g, 0.7 * a * b.std(ddof=1) / a.std(ddof=1) + 0.3 * a)
    assert math.isclose(got.m, (np.exp(a) / np.exp(a).sum()) @ b) and got.n is None


def test_batch_normalised(spark):
    v = np.random.default_rng(2).normal(size=(5, 3))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id int, v array<double>")
    got = {(r.id, r.i): r.v for r in ft.batch_normalised(rows, "v", 2.0, 0.5).collect()}
    want = 2 * (v - v.mean(axis=0)) / np.sqrt(v.var(axis=0) + 1e-5) + 0.5
    assert all(math.isclose(got[i, j], want[i, j], rel_tol=1e-9) for i in range(5) for j in range(3))


def test_time(spark):
    rows = spark.createDataFrame([(1, i, float(i * i)) for i in range(6)], "video long, idx int, value double")
    steps = {(r.stride, r.idx): r.step for r in tp.dyadic_differences(rows).collect()}
    assert steps[1, 3] == 5 and steps[2, 4] == 12 and steps[4, 4] == 16 and len(steps) == 8
    assert [r["mean"] for r in tp.running_mean(rows).orderBy("idx").collect()][:3] == [0, 0.5, 5 / 3]
    views = spark.createDataFrame([(k, i) for k in "ab" for i in range(9)], "k string, item int")
    first = sorted(map(tuple, tp.sampled_views(views, ["k"], "item", 4).collect()))
    assert len(first) == 8 and first == sorted(map(tuple, tp.sampled_views(views.orderBy(F.rand(3)), ["k"], "item", 4).collect()))


def test_gate_and_black(spark):
    px = raster(spark, [[[1.0, 2.0]], [[0.95, 0.2]]], ["depth", "c"])
    assert grid_of(im.confidence_gate(px, F.col("c")), "depth", 1, 2).tolist() == [[1, 0]]
    assert px.filter(im.is_black(-F.col("c"))).count() == 1
    holes = fr.with_holes(px.filter("x = 0"), 1, 2, ("depth",))
    assert grid_of(im.mask_levels(holes), "level", 1, 2).tolist() == [[0, 255]]


def test_to_stereo(spark):
    px = raster(spark, [[[0, 0, 1, 0]], [[0.2, 0.4, 0.6, 1.0]], [[0.0] * 4], [[0.0] * 4]], ["depth", "r", "g", "b"])
    sbs = grid_of(to_stereo(px, 1, 4, max_disparity=2.0, low=0.0, high=1.0), "r", 1, 8)[0]
    # The near third pixel covers the first; its own place is a hole and takes its box's mean.
    assert sbs.tolist() == [51, 102, 153, 255, 153, 102, 170, 255]
    wide = to_stereo(px, 1, 4, max_disparity=2.0, low=0.0, high=1.0, dilate=1, levels=None)
    assert grid_of(wide, "r", 1, 8)[0, 5] == pytest.approx(0.8)
    assert to_stereo(px, 1, 4, "anaglyph", max_disparity=0.0).count() == 4 and to_stereo(px.limit(0), 1, 4).count() == 0
    with pytest.raises(ValueError, match="unknown layout"):
        to_stereo(px, 1, 4, "diagonal")
