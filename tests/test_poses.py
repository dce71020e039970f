"""Errors between posed views, against plain numpy written from the definitions."""

import math

import numpy as np
import pytest

from framelake.operators import poses as po
from pyspark.sql import functions as F

H, W = 9, 13


def pose(rng, turn=0.15, move=0.3):
    """A rigid 4 x 4 matrix from three small angles."""
    a, b, c = rng.uniform(-turn, turn, 3)
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    m = np.eye(4)
    m[:3, :3] = rx @ ry @ rz
    m[:3, 3] = rng.uniform(-move, move, 3)
    return m


def one_way(depth1, depth2, motion, k, mask):
    """Mean relative error of depth1 as seen from the second camera; 0 where nothing counts."""
    fx, fy, cx, cy = k
    arrived = np.zeros((H, W))
    for y in range(H):
        for x in range(W):
            z = depth1[y, x]
            p = motion[:3, :3] @ np.array([(x - cx) * z / fx, (y - cy) * z / fy, z]) + motion[:3, 3]
            if p[2] == 0:
                continue
            u, v = np.rint(p[0] * fx / p[2] + cx), np.rint(p[1] * fy / p[2] + cy)
            if 0 <= u < W and 0 <= v < H:
                arrived[int(v), int(u)] = p[2]
    counts = (arrived > 0) & (depth2 > 0) & mask
    return np.mean(np.abs(depth2[counts] - arrived[counts]) / depth2[counts]) if counts.any() else 0


def by_numpy_tae(depth, poses, ks, masks):
    total = 0
    for i in range(len(depth) - 1):
        there = np.linalg.inv(poses[i + 1]) @ poses[i]
        total += one_way(depth[i], depth[i + 1], there, ks[i], masks[i + 1])
        total += one_way(depth[i + 1], depth[i], np.linalg.inv(there), ks[i], masks[i])
    return total / (2 * (len(depth) - 1)) * 100


def scene(seed, n):
    rng = np.random.default_rng(seed)
    depth = rng.uniform(1, 3, (n, H, W))
    depth[rng.random((n, H, W)) < 0.1] = 0  # no depth, and a point in the camera
    depth[rng.random((n, H, W)) < 0.05] *= -1
    return rng, depth, [pose(rng) for _ in range(n)], rng.random((n, H, W)) < 0.7


def pixel_rows(spark, video, frames, depth, masks=None):
    rows = [(video, f, y, x, float(depth[i, y, x]), bool(masks is None or masks[i, y, x])) for i, f in enumerate(frames) for y in range(H) for x in range(W)]
    return spark.createDataFrame(rows, "video string, frame int, y int, x int, z double, mask boolean")


def test_alignment_error_with_rotation_masks_and_gaps(spark):
    parts, tables, want = [], [], {}
    for seed, (video, frames) in enumerate([("a", [0, 1, 2, 3]), ("b", [5, 9]), ("far", [0, 1])]):
        rng, depth, poses, masks = scene(seed, len(frames))
        if video == "far":
            poses[1][:3, 3] += 1e6
        ks = [(rng.uniform(8, 12), rng.uniform(8, 12), 6.1, 4.2) for _ in frames]
        parts.append(pixel_rows(spark, video, frames, depth, masks))
        tables += [(video, f, [float(v) for v in p.ravel()], [float(v) for v in k]) for f, p, k in zip(frames, poses, ks, strict=True)]
        want[video] = by_numpy_tae(depth, poses, ks, masks)
    want["one"] = 0.0
    tables.append(("one", 0, [float(v) for v in np.eye(4).ravel()], [9.0, 9.0, 6.0, 4.0]))
    table = spark.createDataFrame(tables, "video string, frame int, pose array<double>, k array<double>")
    got = {r.video: r.tae for r in po.temporal_alignment_error(parts[0].union(parts[1]).union(parts[2]), table, W, H).collect()}
    assert got.keys() == want.keys()
    for video in want:
        assert got[video] == pytest.approx(want[video], rel=1e-9), video
    assert want["a"] > 1 and want["far"] == 0


def by_numpy_loss(depth, poses, k):
    """Sum over ordered pairs, with the sampling of a normalised grid whose ends are the edges of pixels."""
    total = 0.0
    for i in range(len(depth)):
        for j in range(len(depth)):
            errors = []
            for y in range(H):
                for x in range(W):
                    d = depth[i, y, x]
                    p = k @ poses[j] @ np.linalg.inv(poses[i]) @ np.linalg.inv(k) @ np.array([x * d, y * d, d, 1.0])
                    p = p / p[3]
                    nx, ny = p[0] / ((W - 1) / 2) - 1, p[1] / ((H - 1) / 2) - 1
                    if max(abs(nx), abs(ny)) > 1 + po.EDGE:
                        continue
                    ix, iy = ((nx + 1) * W - 1) / 2, ((ny + 1) * H - 1) / 2
                    got = 0.0
                    for yy in (math.floor(iy), math.floor(iy) + 1):
                        for xx in (math.floor(ix), math.floor(ix) + 1):
                            if 0 <= yy < H and 0 <= xx < W:
                                got += depth[j, yy, xx] * (1 - abs(ix - xx)) * (1 - abs(iy - yy))
                    errors.append(abs(got - p[2]))
            if errors:
                total += np.mean(errors)
    return total


def test_cross_view_loss(spark):
    k = np.array([[9.0, 0, 6.0, 0], [0, 9.5, 4.0, 0], [0, 0, 1, 0], [0, 0, 0.05, 1]])
    parts, tables, want = [], [], {}
    for seed, (video, frames) in enumerate([("a", [0, 1, 2]), ("b", [4])]):
        rng = np.random.default_rng(seed + 10)
        depth = rng.uniform(0.5, 1.4, (len(frames), H, W))
        poses = [pose(rng) for _ in frames]
        parts.append(pixel_rows(spark, video, frames, depth))
        tables += [(video, f, [float(v) for v in p.ravel()]) for f, p in zip(frames, poses, strict=True)]
        want[video] = by_numpy_loss(depth, poses, k)
    table = spark.createDataFrame(tables, "video string, frame int, pose array<double>")
    got = {r.video: r.loss for r in po.cross_view_loss(parts[0].union(parts[1]), table, tuple(k.ravel()), W, H).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_products_and_inverses(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 4, 4))
    row = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>")
    got = row.select(po.multiply(F.col("a"), F.col("b")).alias("ab"), po.inverse(F.col("a")).alias("inv")).first()
    assert np.allclose(got.ab, (a @ b).ravel()) and np.allclose(got.inv, np.linalg.inv(a).ravel())
