"""Accuracy, geometry, features and time against hand-computed values and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import functions as fn
from framelake.operators import evaluation as ev
from framelake.operators import features as ft
from framelake.operators import geometry as geo
from framelake.operators import temporal as tp


@pytest.fixture
def two_frames(spark):
    p, g = [[1, 2], [4, 4]], [[1, 4], [-1, 5]]
    rows = [(0, 0, f, float(p[f][i]), float(g[f][i])) for f in range(2) for i in range(2)]
    return spark.createDataFrame(rows, "dataset int, scene int, frame int, pred double, gt double")


def test_metrics_by_hand(two_frames):
    row = ev.scene_metrics(ev.frame_metrics(ev.valid(two_frames))).first()
    assert math.isclose(row.abs_rel, 0.225) and math.isclose(row.d1, 0.25) and math.isclose(row.silog, 24.506454, rel_tol=1e-6)


def test_inclusive_mask_needs_pixels(two_frames):
    assert ev.valid_inclusive(two_frames, 1, 4, pixels=2).count() == 2
    assert ev.valid_inclusive(two_frames, 1, 4, pixels=3).count() == 0


def test_scale_shift(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 7.0), ("a", 4.0, 11.0), ("b", 2.0, 3.0), ("b", 2.0, 5.0)], "k string, p double, t double")
    got = {r.k: r for r in ev.scale_shift(rows, ("k",)).collect()}
    assert np.allclose([got["a"].infer_scale, got["a"].infer_shift], [2, 3])
    assert (got["b"].infer_scale, got["b"].infer_shift, got["b"].loss_scale) == (1, 0, 0)


def test_alignment_recovers_scale_and_shift(spark):
    rng = np.random.default_rng(0)
    gt = rng.uniform(1, 50, 60)
    rows = spark.createDataFrame([(0, 0, 0, float(g), float((1 / g - 0.2) / 3 + 1)) for g in gt], "dataset int, scene int, frame int, gt double, pred_disp double")
    assert np.allclose([abs(r.pred - r.gt) for r in ev.align(rows).collect()], 0, atol=1e-3)


def test_robust_bounds_take_the_lower_median(spark):
    rows = spark.createDataFrame([("v", 0, float(x), True) for x in (1, 2, 3, 4)], "video string, frame int, v double, mask boolean")
    row = ev.robust_bounds(rows).first()
    assert (row.middle, row.spread) == (2.0, 1.0)


def test_trimmed_mae(spark):
    rows = spark.createDataFrame([(0, 0, float(x), 0.0) for x in (1, 2, 3, 4, 100)], "dataset int, scene int, pred double, gt double")
    assert ev.trimmed_mae(rows).first().loss == 2.0


@pytest.mark.parametrize("trim", [0.0, 0.2, 0.55, 1.0])
def test_trimmed_mae_against_numpy(spark, trim):
    rng = np.random.default_rng(9)
    values = {"even": rng.random(500), "ties": rng.integers(0, 3, 300).astype(float), "skewed": np.append(rng.random(200) * 1e-6, 1e6), "zero": np.zeros(40), "one": np.ones(1)}
    rows = spark.createDataFrame([(k, 0, float(x), 0.0) for k, v in values.items() for x in v] + [("even", 0, None, 1.0)], "dataset string, scene int, pred double, gt double")
    got = {r.dataset: r.loss for r in ev.trimmed_mae(rows, trim, per_octave=2).collect()}
    for k, v in values.items():
        assert math.isclose(got[k], np.sort(v)[: int(np.floor(len(v) * (1 - trim)))].sum() / len(v), abs_tol=1e-12)


def test_gradient_loss(spark):
    image = np.random.default_rng(3).random((8, 8))
    rows = spark.createDataFrame([("v", 0, y, x, float(image[y, x])) for y in range(8) for x in range(8)], "video string, frame int, y int, x int, diff double")
    want = 0.0
    for s in (1, 2, 4, 8):
        g = image[::s, ::s]
        want += (np.abs(np.diff(g, axis=0)).sum() + np.abs(np.diff(g, axis=1)).sum()) / g.size
    assert math.isclose(ev.gradient_loss(rows).first().loss, want)


def test_ssim_against_numpy(spark):
    rng = np.random.default_rng(6)
    a = rng.random((14, 15))
    b = np.clip(a + rng.normal(0, 0.1, a.shape), 0, 1)
    rows = spark.createDataFrame([("v", 0, y, x, float(a[y, x]), float(b[y, x])) for y in range(14) for x in range(15)], "video string, frame int, y int, x int, a double, b double")
    w = np.array(ev.gaussian())

    def blur(m):
        m = np.pad(m, 5)
        m = np.stack([np.convolve(r, w, "valid") for r in m])
        return np.stack([np.convolve(c, w, "valid") for c in m.T]).T

    ma, mb = blur(a), blur(b)
    want = ((2 * ma * mb + 1e-4) * (2 * (blur(a * b) - ma * mb) + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (blur(a * a) - ma**2 + blur(b * b) - mb**2 + 9e-4))).mean()
    assert math.isclose(ev.ssim(rows, "a", "b").first().ssim, want, rel_tol=1e-9)
    assert math.isclose(ev.ssim(rows, "a", "a").first().ssim, 1.0, rel_tol=1e-9)


def test_weighted_losses():
    assert ev.weighted_losses(["5.0_l1", "10.0_content"]) == [(1.0, "l1"), (10.0, "content")]


def test_projection_undoes_unprojection(spark):
    rows = spark.createDataFrame([(3, 5, 2.0), (60, 1, 0.001)], "x int, y int, z double")
    c = geo.unproject(F.col("x"), F.col("y"), F.col("z"), 64, 32, 50.0)
    u, v = geo.project(*c, 64, 32, 50.0)
    a, b = rows.select(u.alias("u"), v.alias("v")).collect()
    assert np.allclose([a.u, a.v], [3, 5]) and (b.u, b.v) == (-10, -10)


def test_inverse_pose(spark):
    m = [0.0, -1.0, 0.0, 2.0, 1.0, 0.0, 0.0, 3.0, 0.0, 0.0, 1.0, 4.0, 0.0, 0.0, 0.0, 1.0]
    cols = [F.lit(x) for x in m]
    p = geo.transform_point(geo.invert_pose(cols), *geo.transform_point(cols, F.lit(7.0), F.lit(8.0), F.lit(9.0)))
    assert np.allclose(tuple(spark.range(1).select(*p).first()), (7, 8, 9))


def test_splat_keeps_the_nearest(spark):
    rows = [("v", 0, 2.0, 2.0, float(z), float(z), i) for i, z in enumerate((3, 1, 2))]
    points = spark.createDataFrame(rows, "video string, frame int, u double, v double, z double, value double, src int")
    got = {(r.y, r.x): r for r in geo.splat(points, 5, 5, nearest=2).collect()}
    assert math.isclose(got[2, 2].wsumnorm, 1.5)
    assert got[2, 3].wsum == 0.0  # on the rim of its reach a point weighs nothing


def test_features(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6, 8))
    rows = spark.createDataFrame([(i, i % 2, [float(x) for x in r]) for i, r in enumerate(v)], "id int, k int, v array<double>")
    gram = {(r.k, r.i, r.j): r.g for r in ft.gram(rows, "k", "v", 8).collect()}
    for k in range(2):
        want = v[k::2].T @ v[k::2] / 3
        assert all(math.isclose(gram[k, i, j], want[i, j], abs_tol=1e-12) for i in range(8) for j in range(i, 8))
    soft = np.array(rows.orderBy("id").select(ft.softmax(F.col("v")).alias("p")).toPandas().p.tolist())
    want = np.exp(v) / np.exp(v).sum(axis=1, keepdims=True)
    assert np.allclose(soft, want)
    parts = np.array(rows.orderBy("id").select(ft.group_correlation(F.col("v"), F.col("v"), 2, 8).alias("c")).toPandas().c.tolist())
    assert np.allclose(parts, (v**2).reshape(6, 2, 4).mean(axis=2))
    m = ft.moments(rows, "v").orderBy("i").toPandas()
    assert np.allclose(m["mean"], v.mean(axis=0)) and np.allclose(m.var_unbiased, v.var(axis=0, ddof=1))


def test_positional_encoding(spark):
    got = spark.createDataFrame([(0.3,)], "c double").select(fn.positional_encoding(F.col("c"), 2).alias("e")).first().e
    assert np.allclose(got, [np.sin(0.3 * np.pi), np.cos(0.3 * np.pi), np.sin(0.6 * np.pi), np.cos(0.6 * np.pi)])


def stream(spark, values, video=1):
    return spark.createDataFrame([(video, i, float(x)) for i, x in enumerate(values)], "video long, idx int, value double")


def test_ema_by_hand(spark):
    rows = stream(spark, [10, 20, 20, 0])
    for f in (tp.ema, tp.ema_long):
        assert [r.smoothed for r in f(rows, 0.75).orderBy("idx").collect()] == [10, 17.5, 19.375, 4.84375]
        assert [r.smoothed for r in f(rows, 0).orderBy("idx").collect()] == [10, 20, 20, 0]
        assert f(rows.limit(0), 0.75).count() == 0


def simulated_windows(n):
    """Windows with each one's first ten slots taken from the one before, frame by frame."""
    append = (22 - n % 22) % 22 + 10
    padded = [min(i, n - 1) for i in range(n + append)]
    out, previous = [], None
    for start in range(0, n, 22):
        window = padded[start : start + 32]
        if previous is not None:
            window[:10] = [previous[k] for k in (0, 12, *range(24, 32))]
        out.append(list(window))
        previous = window
    return out


@pytest.mark.parametrize("n", [1, 21, 22, 23, 44, 45, 100])
def test_windows_against_simulation(spark, n):
    rows = tp.windows(spark.createDataFrame([(1, n)], "video long, n long")).orderBy("window", "slot").collect()
    got = [[r.frame for r in rows[i : i + 32]] for i in range(0, len(rows), 32)]
    assert got == simulated_windows(n)


def test_cache_slots(spark):
    rows = tp.cache_slots(spark.createDataFrame([(1, 60)], "video long, n long")).filter("t = 50").orderBy("slot").collect()
    assert [r.frame for r in rows] == [0, 9, *range(21, 50)]


def test_alignment_chain_undoes_window_scales(spark):
    rng = np.random.default_rng(5)
    n = 70
    truth = rng.uniform(1, 5, n)
    windows = np.array([[truth[f] for f in w] for w in simulated_windows(n)])
    moved = np.stack([w if k == 0 else (w - 0.3 * k) / (1 + k) for k, w in enumerate(windows)])[:, :, None]
    assert np.allclose(tp.alignment_chain(moved)[:n, 0], truth)
    frames = simulated_windows(n)
    rows = [(1, k, j, frames[k][j], float(moved[k, j, 0])) for k in range(len(moved)) for j in range(32)]
    got = tp.align_windows(spark.createDataFrame(rows, "video long, window int, slot int, frame int, value double")).orderBy("frame").toPandas().value
    assert len(got) == n and np.allclose(got, truth)


def test_taps_clamp(spark):
    rows = tp.tap_pool(stream(spark, [1, 2, 3])).orderBy("idx").collect()
    assert [rows[0][f"tap_{i}"] for i in range(5)] == [1, 1, 1, 2, 3]


def test_strides(spark):
    rows = stream(spark, range(20))
    kept = lambda backend: [r.idx for r in tp.sampled(rows, F.lit(24.0), 12.0, 5, backend).orderBy("idx").collect()]
    assert kept("decord") == [0, 2, 4, 6, 8] and kept("cv2") == [0, 2, 4]


def test_chunks_drop_the_tail(spark):
    assert tp.whole_chunks(stream(spark, range(10)), 4).count() == 8


def _images(spark, errors):
    """Images of two pixels, which differ by the frame's error in each channel of the first."""
    rows = [("a", frame, x, 0.5, 0.25, 0.0, *[c + (e if x == 0 else 0.0) for c in (0.5, 0.25, 0.0)]) for frame, e in enumerate(errors) for x in range(2)]
    return spark.createDataFrame(rows, "video string, frame int, x int, r double, g double, b double, r2 double, g2 double, b2 double")


def test_psnr_of_equal_images_is_infinite(spark):
    got = {r.frame: r.psnr for r in ev.psnr(_images(spark, [0.0, 0.5])).collect()}
    assert got[0] == math.inf and math.isclose(got[1], 10 * math.log10(1 / (3 * 0.25 / 2)))


def test_split_means_keep_infinite_ratios(spark):
    from framelake.operators import losses as ls

    each = ev.psnr(_images(spark, [0.5, 0.0, 0.5]))
    [split] = ls.split_means(each, ("psnr",), F.col("frame") == 1, ("video",)).collect()
    assert split.psnr_all == math.inf and math.isclose(split.psnr_rest, 10 * math.log10(1 / (3 * 0.25 / 2)))


def test_smoothing_takes_no_group_of_its_own_for_each_video(spark):
    """Many short videos and a long one, of many blocks, without a group in Python for each."""
    rng = np.random.default_rng(6)
    values = {**{k: rng.normal(size=1 + k % 7) for k in range(40)}, None: rng.normal(size=90)}
    rows = spark.createDataFrame([(k, i, float(x)) for k, v in values.items() for i, x in enumerate(v)], "video long, idx long, value double").repartition(3)
    out = tp.ema(rows, 0.75, block=4)
    got = {(r.video, r.idx): r.smoothed for r in out.collect()}
    for k, v in values.items():
        x = v[0]
        for i, each in enumerate(v):
            x = 0.75 * each + 0.25 * x
            assert math.isclose(got.pop((k, i)), x, rel_tol=1e-12)
    assert not got and "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_split_psnr_of_equal_images_is_as_in_its_sql(spark, tmp_path):
    """Colours are even in the frames named here, so that both views are equal; in others they grow along x."""
    import duckdb

    from framelake.plans.queries import ORACLES, QUERIES

    even = {"A": (1,), "N": (2,), "R": ()}
    rows = [(video, f, y, x, 100.0 * x + y, 50.0 if f in frames else float(x), 0.1, 0.08) for video, frames in even.items() for f in (1, 2, 3) for y in range(4) for x in range(64)]
    lines = "l_returnflag string, l_linenumber int, l_orderkey long, l_partkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["a31_split_psnr"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(ORACLES["a31_split_psnr"]).fetchall())
    assert [(math.isinf(a), math.isinf(rest)) for _, a, rest in got] == [(True, False), (True, True), (False, False)]
