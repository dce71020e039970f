"""Operators against plain numpy that shares nothing with them, with masks, noise and ragged input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import functions as fn
from framelake.operators import evaluation as ev
from framelake.operators import features as ft
from framelake.operators import geometry as geo
from framelake.operators import images as im
from framelake.operators import temporal as tp
from framelake.sources import manifest as mf
from framelake.sources import sinks

RNG = np.random.default_rng(5)


def grid(spark, **planes):
    h, w = next(iter(planes.values())).shape
    rows = [("v", 0, y, x, *[float(p[y, x]) for p in planes.values()]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "video string, frame int, y int, x int, " + ", ".join(f"{n} double" for n in planes))


def test_general_inverse(spark):
    matrices = [*RNG.normal(size=(6, 4, 4)), np.eye(4)[[2, 0, 3, 1]], np.ones((4, 4))]
    rows = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(matrices)], "i int, m array<double>")
    got = rows.select("i", geo.invert_matrix([F.get("m", F.lit(k)) for k in range(16)]).alias("r")).orderBy("i").collect()
    for m, r in zip(matrices[:-1], got, strict=False):
        assert np.allclose(np.reshape(r.r, (4, 4)), np.linalg.inv(m))
    assert got[-1].r == [None] * 16


def test_rotation_keeps_relative_positions(spark):
    a, b = RNG.normal(size=(2, 8))
    turn = lambda v, p: fn.rotary_vector(F.array(*map(F.lit, map(float, v))), F.lit(p), 8)
    near, far = spark.range(1).select(fn.dot(turn(a, 3), turn(b, 5)), fn.dot(turn(a, 103), turn(b, 105))).first()
    assert near == pytest.approx(far)
    table = spark.range(1).select(fn.sinusoidal(F.lit(3), 4)).first()[0]
    assert table == pytest.approx([np.sin(3), np.cos(3), np.sin(0.03), np.cos(0.03)])


def test_box_similarity(spark):
    a, b = RNG.random((2, 12, 15))
    a[2:9, 2:9] = b[2:9, 2:9] = 0.5
    got = ev.box_ssim(grid(spark, a=a, b=b), [("a", "b")], 12, 15).first().ssim
    each = []
    for y in range(3, 9):
        for x in range(3, 12):
            p, q = (m[y - 3:y + 4, x - 3:x + 4].ravel() for m in (a, b))
            (vp, c), (_, vq) = np.cov(p, q)
            each.append((2 * p.mean() * q.mean() + 1e-4) * (2 * c + 9e-4) / ((p.mean() ** 2 + q.mean() ** 2 + 1e-4) * (vp + vq + 9e-4)))
    assert got == pytest.approx(np.mean(each))


def test_masked_similarity(spark):
    a, b = RNG.random((2, 13, 14))
    mask = (RNG.random((13, 14)) < 0.4).astype(float)
    g = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    g = np.outer(g, g) / g.sum() ** 2

    def mean(m):
        wide = np.pad(m, 5)
        return np.array([[(wide[y:y + 11, x:x + 11] * g).sum() for x in range(14)] for y in range(13)])

    ma, mb = mean(a), mean(b)
    value = (2 * ma * mb + 1e-4) * (2 * (mean(a * b) - ma * mb) + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (mean(a * a) - ma**2 + mean(b * b) - mb**2 + 9e-4))
    got = lambda m: ev.ssim(grid(spark, a=a, b=b, m=m), "a", "b", mask="m").first().ssim
    assert got(mask) == pytest.approx((value * mask).sum() / mask.sum())
    assert got(mask * 0) == 0


def test_running_moments_of_ragged_batches(spark):
    batches = [RNG.normal(size=(n, 3)) for n in (4, 1, 7, 2)]
    rows = spark.createDataFrame([(k, r.tolist()) for k, b in enumerate(batches) for r in b], "batch int, v array<double>")
    mean, variance = np.zeros(3), np.ones(3)
    for b in batches:
        mean = 0.7 * mean + 0.3 * b.mean(axis=0)
        variance = 0.7 * variance + 0.3 * b.var(axis=0, ddof=1) if len(b) > 1 else variance
    got = ft.running_moments(rows, "batch", "v", 0.3).orderBy("i").collect()
    assert np.allclose([r["mean"] for r in got], mean) and np.allclose([r.variance for r in got], variance)
    assert ft.running_moments(rows.limit(0), "batch", "v").count() == 0


def test_layers_and_views(spark):
    a, b = RNG.normal(size=(2, 2, 5, 4))
    a[0, 0] = 0
    rows = spark.createDataFrame([("p", k, a[k, i].tolist(), b[k, i].tolist()) for k in range(2) for i in range(5)], "pair string, layer int, a array<double>, b array<double>")
    unit = lambda m: m / (np.linalg.norm(m, axis=-1, keepdims=True) + 1e-10)
    want = sum(1 - (unit(a[k]) * unit(b[k])).sum(axis=-1).mean() for k in range(2))
    assert ft.layer_distance(rows, ["pair"], "layer", "a", "b").first().distance == pytest.approx(want)
    views = spark.createDataFrame([(1, 2.0, 0.5), (1, 8.0, 1.5), (2, 3.0, 0.0)], "k int, c double, w double")
    assert dict(map(tuple, ft.view_weighted(views, ["k"], "c", "w").collect())) == {1: 6.5, 2: None}


def test_pool_with_its_own_output(spark):
    clips = {"a": RNG.normal(size=23), "b": RNG.normal(size=3)}
    rows = spark.createDataFrame([(k, i, float(x)) for k, c in clips.items() for i, x in enumerate(c)], "video string, idx int, value double")
    weights = np.array([0.1, 0.2, 0.3, -0.4, 0.5, 0.6])
    got = {(r.video, r.idx): r.out for r in tp.recurrent_pool(rows, lambda pool: float(pool @ weights)).collect()}
    for k, c in clips.items():
        out = c[0]
        for t in range(len(c)):
            near, far, now, after, late = (c[min(max(t + d, 0), len(c) - 1)] for d in (-1, -5, 0, 1, 5))
            out = np.array([far, near, out, now, after, late]) @ weights
            assert got[k, t] == pytest.approx(out)
    assert len(got) == 26


def test_nested_stages(spark):
    rows = spark.createDataFrame([("depth", None, 3.0), ("depth", None, 1.0), ("warp", None, 6.0), ("read", "depth", 1.0), ("idle", "lost", 0.0)], "stage string, parent string, seconds double")
    got = {r.stage: (r.seconds, r.share, r.fps) for r in tp.nested_stage_report(rows, 20).collect()}
    assert got == {"depth": (4.0, 0.4, 5.0), "warp": (6.0, 0.6, pytest.approx(20 / 6)), "read": (1.0, 0.25, 20.0), "idle": (0.0, 0.0, pytest.approx(2e7))}


def test_both_eyes_keep_their_size(spark):
    ramp = np.add.outer(np.arange(6.0) * 10, np.arange(8.0))
    left, right = grid(spark, r=ramp, g=ramp, b=ramp), grid(spark, r=-ramp, g=ramp, b=ramp)
    out = {(r.eye, r.y, r.x): r.r for r in im.trimmed_pair(left, right, 2, 6, 8).collect()}
    assert len(out) == 2 * 48 and out["left", 0, 0] == 0.0
    # The last kept pixel, (3, 5), reaches the corner, and the middle is linear.
    assert out["left", 5, 7] == pytest.approx(35.0) and out["right", 5, 7] == pytest.approx(-35.0)
    assert out["left", 2, 3] == pytest.approx((2.5 * 4 / 6 - 0.5) * 10 + 3.5 * 6 / 8 - 0.5)


def test_manifest_with_cameras(spark):
    rows = spark.createDataFrame([("d", "s", 0, "a.jpg", "a.png", 1000.0, [[1.0, 0.0], [0.0, 2.0]], [[3.0]])], "dataset string, scene string, frame int, image string, gt_depth string, factor double, K array<array<double>>, pose array<array<double>>")
    back = mf.flatten_manifest(mf.build_manifest(rows)).first()
    assert back.K == [[1.0, 0.0], [0.0, 2.0]] and back.pose == [[3.0]] and back.factor == 1000.0
    assert mf.flatten_manifest(mf.build_manifest(rows.drop("K", "pose"))).first().K is None


def test_point_clouds_are_whole_files(spark, tmp_path):
    points = spark.createDataFrame([(f, float(i), 0.5, -1.0, 0.0, 0.5, 1.0) for f, n in ((1, 3), (2, 200)) for i in range(n)], "frame int, x double, y double, z double, r double, g double, b double")
    sinks.write_ply_files(points.repartition(7), str(tmp_path / "clouds"))
    for frame, n in ((1, 3), (2, 200)):
        files = list((tmp_path / "clouds" / f"frame={frame}").glob("part-*"))
        lines = files[0].read_text().splitlines()
        assert len(files) == 1 and lines[:3] == ["ply", "format ascii 1.0", f"element vertex {n}"] and lines[9] == "end_header"
        assert len(lines) == 10 + n and all(len(line.split()) == 6 for line in lines[10:])
