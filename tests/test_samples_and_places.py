"""Multi-view samples and hypotheses between pixels, against plain Python and numpy."""

import hashlib
import math

import numpy as np
import pytest

from framelake.operators import patchmatch as pm
from framelake.operators import samples as sa
from pyspark.sql import functions as F

H, W = 6, 9


def between(grid, v, u):
    """Value at a place of a normalised grid whose ends are edges of pixels; edges repeat."""
    v, u = (min(max(((2 * p / (n - 1)) * n - 1) / 2, 0), n - 1) for p, n in ((v, H), (u, W)))
    y, x = int(v), int(u)
    y1, x1 = min(y + 1, H - 1), min(x + 1, W - 1)
    return (grid[y, x] * (1 - u + x) + grid[y, x1] * (u - x)) * (1 - v + y) + (grid[y1, x] * (1 - u + x) + grid[y1, x1] * (u - x)) * (v - y)


def tables(spark, seed, k=5):
    rng = np.random.default_rng(seed)
    depth = rng.uniform(1, 5, (2, H, W))
    places = rng.uniform(-3, 3, (2, H, W, k, 2))
    places[0, :, :, 0] = 0  # the pixel itself, which isn't where it is
    px = spark.createDataFrame([("v", f, y, x, float(depth[f, y, x])) for f in range(2) for y in range(H) for x in range(W)], "video string, frame int, y int, x int, depth double")
    offsets = spark.createDataFrame([("v", f, y, x, i, *map(float, places[f, y, x, i])) for f in range(2) for y in range(H) for x in range(W) for i in range(k)], "video string, frame int, y int, x int, k int, dy double, dx double")
    return depth, places, px, offsets


def test_places_between_pixels(spark):
    depth, places, px, offsets = tables(spark, 1)
    got = {(r.frame, r.y, r.x, r.k): r.sampled for r in pm.looked_at(px, offsets, H, W).collect()}
    want = {(f, y, x, i): between(depth[f], y + places[f, y, x, i, 0], x + places[f, y, x, i, 1]) for f in range(2) for y in range(H) for x in range(W) for i in range(5)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_hypotheses_are_propagated(spark):
    depth, places, px, offsets = tables(spark, 2)
    given = px.select("video", "frame", "y", "x", F.array(F.col("depth") - 0.5, F.col("depth"), F.col("depth") + 0.25).alias("depths"))
    for r in pm.propagated(given, offsets, H, W).collect():
        d = depth[r.frame, r.y, r.x]
        near = [between(depth[r.frame], r.y + places[r.frame, r.y, r.x, i, 0], r.x + places[r.frame, r.y, r.x, i, 1]) for i in range(5)]
        assert np.allclose(r.depths, sorted([d - 0.5, d, d + 0.25, *near]))
    alone = pm.propagated(given, offsets.limit(0), H, W).first().depths
    assert len(alone) == 3


def test_weights_compare_shares_of_the_inverse_range(spark):
    depth, places, px, offsets = tables(spark, 3)
    share = (1 / depth - 1 / 6) / (1 / 0.5 - 1 / 6)
    for r in pm.neighbour_weights(px, offsets, H, W, 0.5, 6.0, 0.025).collect():
        near = between(share[r.frame], r.y + places[r.frame, r.y, r.x, r.k, 0], r.x + places[r.frame, r.y, r.x, r.k, 1])
        far = min(max(abs(near - share[r.frame, r.y, r.x]) / 0.025, 0), 4)
        assert math.isclose(r.weight, 1 / (1 + math.exp(-(2 - far) * 2)), rel_tol=1e-9)


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_one_light_for_each_sample(spark):
    lights = ["_0_max", "_3_r", "_6"]
    rows = [(s, f"/d/{s}/image/rect_{i:03d}{light}.{kind}") for s in ("scan1", "scan2", "scan7", "scan9") for i in (2, 0, 1) for light in lights for kind in ("png", "txt")]
    got = sa.lit_images(spark.createDataFrame(rows, "scan string, path string"), ["scan"], lights).collect()
    assert len(got) == 12 and len({r.light for r in got}) > 1
    for r in got:
        light = lights[int(int(md5("light", r.scan)[:8], 16) / 2**32 * 3)]
        assert r.light == light and r.path == f"/d/{r.scan}/image/rect_{r.place:03d}{light}.png"


def test_views_are_drawn_by_sample_and_inputs_come_again(spark):
    rows = [(f"s{s}", i) for s in range(60) for i in range(7 if s else 3)]
    views = spark.createDataFrame(rows, "scan string, place int").repartition(3)
    plain = {}
    for r in sa.drawn_views(views, ["scan"], 5, 2).collect():
        plain.setdefault(r.scan, {})[r.slot] = r.place
    for s in range(60):
        order = sorted(range(7 if s else 3), key=lambda i: md5("views", f"s{s}", i))[:5]
        assert [plain[f"s{s}"][k] for k in range(len(order))] == order
    assert len({tuple(sorted(x.items())) for x in plain.values()}) > 20
    again = {}
    for r in sa.drawn_views(views, ["scan"], 5, 2, reuse=0.4).collect():
        again.setdefault(r.scan, {})[r.slot] = r.place
    reused = 0
    for s, slots in plain.items():
        want = dict(slots)
        for i in range(2):
            if i + 2 in want and int(md5("views reuse", s, i)[:8], 16) / 2**32 <= 0.4:
                want[i + 2], reused = slots[i], reused + 1
        assert again[s] == want
    assert 25 < reused < 70
    fixed = sa.fixed_views(views, ["scan"], [5, 1]).collect()
    assert [r.place for r in sorted(fixed, key=lambda r: r.slot) if r.scan == "s4"] == [5, 1, 0, 2, 3, 4, 6]
    assert [r.place for r in sorted(fixed, key=lambda r: r.slot) if r.scan == "s0"] == [1, 0, 2]


def test_cameras_of_a_sample(spark):
    rng = np.random.default_rng(5)
    cams = {i: (np.linalg.qr(rng.normal(size=(3, 3)))[0], rng.normal(size=3), np.array([[9 + i, 0, 3], [0, 8 + i, 2], [0, 0, 1.0]])) for i in range(4)}
    cameras = spark.createDataFrame([(i, *(m.ravel().tolist() for m in c)) for i, c in cams.items()], "place int, rotation array<double>, translation array<double>, intrinsics array<double>")
    views = spark.createDataFrame([("a", 0, 3), ("a", 1, 1), ("a", 2, 3), ("b", 0, 0)], "scan string, slot int, place int")
    for after in (True, False):
        for r in sa.with_cameras(views, cameras, ["scan"], ["place"], scale=200.0, resized=0.5, invert_resized=after).collect():
            pose = np.eye(4)
            pose[:3, :3], pose[:3, 3] = cams[r.place][0], cams[r.place][1] / 200
            k = np.eye(4)
            k[:3, :3] = np.mean([cams[p][2] for p in ((3, 1, 3) if r.scan == "a" else (0,))], axis=0)
            small = k.copy()
            small[0:2, 0:3] *= 0.5
            assert np.allclose(r.pose, pose.ravel()) and np.allclose(r.pose_inverse, np.linalg.inv(pose).ravel())
            assert np.allclose(r.k, small.ravel()) and np.allclose(r.k_inverse, np.linalg.inv(small if after else k).ravel())


def test_boxes_and_black(spark):
    px = spark.createDataFrame([("a", y, x, float(2 <= y <= 3 and 1 <= x <= 5)) for y in range(6) for x in range(8)], "view string, y int, x int, m double")
    assert sa.mask_boxes(px, ["view"], F.col("m") > 0, 0.5).first().box == [0.5, 1.0, 2.5, 1.5]
    with pytest.raises(Exception, match="empty mask of view a"):
        sa.mask_boxes(px, ["view"], F.col("m") > 1).collect()
    rgb = spark.createDataFrame([(-1.0, -0.95, -1.0), (-1.0, -0.9, -1.0)], "r double, g double, b double")
    assert [r.mask for r in sa.black_mask(rgb).collect()] == [False, True]
