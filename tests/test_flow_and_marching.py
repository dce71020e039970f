"""Optical flow on known movements, and fast-marching inpainting against a plain replay."""

import numpy as np
import pytest

from framelake.operators import flow as fl
from framelake.operators import marching as mi
from framelake.operators import temporal as tp


def scene(seed, h=96, w=128):
    """A smooth image that is known between pixels: waves of several directions."""
    rng = np.random.default_rng(seed)
    waves = [(*rng.uniform(-0.35, 0.35, 2), rng.uniform(0, 6), rng.uniform(5, 20)) for _ in range(25)]
    return lambda y, x: 128 + sum(a * np.sin(fy * y + fx * x + p) for fy, fx, p, a in waves)


def drawn(f, dy, dx, h=96, w=128):
    ys, xs = np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij")
    return f(ys - dy, xs - dx)


@pytest.mark.parametrize(("dx", "dy"), [(0.0, 0.0), (0.4, -0.3), (2.5, 1.25), (-6.0, 3.5)])
def test_known_shifts_are_recovered(dx, dy):
    f = scene(3)
    flow = fl.farneback(drawn(f, 0, 0), drawn(f, dy, dx))
    inner = flow[20:-20, 20:-20]
    assert np.abs(inner - (dx, dy)).max() < 0.1


def test_a_turn_is_recovered():
    f = scene(5)
    ys, xs = np.meshgrid(np.arange(96.0) - 48, np.arange(128.0) - 64, indexing="ij")
    a = 0.02
    first, second = f(ys + 48, xs + 64), f(np.cos(a) * ys - np.sin(a) * xs + 48, np.sin(a) * ys + np.cos(a) * xs + 64)
    flow = fl.farneback(first, second)
    want = np.stack([np.cos(a) * xs - np.sin(a) * ys, np.sin(a) * xs + np.cos(a) * ys], axis=-1) - np.stack([xs, ys], axis=-1)
    assert np.abs(flow - want)[20:-20, 20:-20].mean() < 0.1


def test_expansion_of_a_quadratic_is_its_terms():
    ys, xs = np.meshgrid(np.arange(30.0), np.arange(40.0), indexing="ij")
    got = fl.expansion(3 + 2 * xs - ys + 0.5 * xs * xs - 0.25 * ys * ys + 0.1 * xs * ys)[15, 20]
    assert np.allclose(got, [2 + 20 + 0.1 * 15, -1 - 0.5 * 15 + 0.1 * 20, 0.5, -0.25, 0.1])


def test_flow_of_frames_feeds_the_smoothing(spark):
    h, w, f = 48, 64, scene(7)
    rows = [(v, i, drawn(f, 0.5 * i * s, 1.0 * i * s, h, w).ravel().tolist(), (drawn(f, 0.5 * i * s, 1.0 * i * s, h, w) / 50).ravel().tolist()) for v, s in (("a", 1), ("b", 0)) for i in range(4)]
    frames = spark.createDataFrame(rows, "video string, idx int, gray array<double>, depth array<double>").repartition(3)
    flow = fl.optical_flow(frames, h, w)
    got = {(r.video, r.idx): r for r in flow.collect()}
    for i in range(4):
        at = np.array(got["a", i].dx).reshape(h, w)[16:-16, 16:-16]
        assert np.abs(at - (1.0 if i else 0.0)).max() < 0.15
        assert np.abs(got["b", i].dx).max() < 1e-6 and got["a", i].depth == pytest.approx(rows[i][3])
    smooth = {(r.video, r.idx): r.depth for r in tp.smooth_along_flow(flow, 0.5, h, w).collect()}
    assert np.allclose(smooth["b", 3], rows[7][3])  # nothing moves, nothing changes


def replay(image, hole, radius):
    """The same filling without a queue: always the least arrival among all rim pixels, found by looking at each."""
    h, w = hole.shape
    near = lambda y, x: [(a, b) for a, b in ((y - 1, x), (y, x - 1), (y + 1, x), (y, x + 1)) if 0 <= a < h and 0 <= b < w]

    def solve(time, done, y, x):
        best = 1e6
        for a in (y - 1, y + 1):
            for b in (x - 1, x + 1):
                p = time[a, x] if 0 <= a < h and done[a, x] else 1e6
                q = time[y, b] if 0 <= b < w and done[y, b] else 1e6
                low, high = min(p, q), max(p, q)
                if low < 1e6:
                    best = min(best, low + 1 if high - low >= 1 else (low + high + (2 - (high - low) ** 2) ** 0.5) / 2)
        return best

    def front(area, start, limit, tell):
        time, seen = np.full((h, w), 1e6), ~area
        if not area.any():
            return time
        for y, x in start:
            time[y, x], seen[y, x] = 0, True
        outer = {(y, x) for y, x in start}
        while outer:
            y, x = min(outer, key=lambda c: (time[c], c))
            if time[y, x] > limit:
                break
            outer.remove((y, x))
            for a, b in near(y, x):
                if area[a, b] and not seen[a, b]:
                    time[a, b] = solve(time, seen, a, b)
                    tell(a, b, time, seen)
                    seen[a, b] = True
                    outer.add((a, b))
        return time

    rim = [(y, x) for y in range(h) for x in range(w) if not hole[y, x] and any(hole[c] for c in near(y, x))]
    out = image.astype(float).copy()
    back = front(~hole, rim, 2 * radius, lambda *_: None)

    def diff(values, seen, y, x):
        parts = []
        for a, b in ((1, 0), (0, 1)):
            up, down = (y + a, x + b), (y - a, x - b)
            ok = [0 <= c[0] < h and 0 <= c[1] < w and seen[c] for c in (up, down)]
            parts.append((values[up] - values[down]) / 2 if all(ok) else values[up] - values[y, x] if ok[0] else values[y, x] - values[down] if ok[1] else values[y, x] * 0)
        return parts

    def fill(y, x, time, seen):
        time = np.where(hole, time, -back)
        gy, gx = diff(time, seen, y, x)
        total, mean = 0, 0
        for v in range(h):
            for u in range(w):
                d = (y - v) ** 2 + (x - u) ** 2
                if seen[v, u] and 0 < d <= radius**2:
                    weight = max(abs((y - v) * gy + (x - u) * gx) / d**0.5, 1e-6) / d / (1 + abs(time[v, u] - time[y, x]))
                    sy, sx = diff(out, seen, v, u)
                    total, mean = total + weight, mean + weight * (out[v, u] + sy * (y - v) + sx * (x - u))
        out[y, x] = mean / total

    front(hole, rim, 1e6, fill)
    return out


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_marching_against_a_replay(radius):
    rng = np.random.default_rng(radius)
    for k in range(6):
        image = rng.integers(0, 256, (9, 11, 3)).astype(float)
        hole = rng.random((9, 11)) < (0.15, 0.3, 0.5, 0.7, 0.9, 0.05)[k]
        hole[2:6, 3:7] = True
        got = mi.marching_fill(image, hole, radius)
        assert np.allclose(got, replay(image, hole, radius), rtol=1e-9) and np.array_equal(got[~hole], image[~hole])


def test_marching_keeps_slopes_and_constants():
    ys, xs = np.meshgrid(np.arange(12.0), np.arange(14.0), indexing="ij")
    hole = np.zeros((12, 14), bool)
    hole[4:8, 5:9] = True
    flat = np.full((12, 14, 1), 7.0)
    assert np.allclose(mi.marching_fill(flat, hole), flat)
    slope = (3 * xs + 2 * ys)[..., None]
    assert np.abs(mi.marching_fill(np.where(hole[..., None], 0, slope), hole) - slope).max() < 6
    assert np.array_equal(mi.marching_fill(flat, np.ones((12, 14), bool)), flat)
    assert np.array_equal(mi.marching_fill(flat, np.zeros((12, 14), bool)), flat)


def test_marching_of_frames(spark):
    rng = np.random.default_rng(1)
    image, hole = rng.integers(0, 256, (2, 6, 8, 3)), rng.random((2, 6, 8)) < 0.3
    rows = [("v", f, y, x, *(None if hole[f, y, x] else int(c) for c in image[f, y, x]), bool(hole[f, y, x])) for f in range(2) for y in range(6) for x in range(8)]
    got = mi.marching_inpaint(spark.createDataFrame(rows, "video string, frame int, y int, x int, r int, g int, b int, hole boolean"), 6, 8).collect()
    want = {f: np.clip(np.rint(mi.marching_fill(np.where(hole[f][..., None], 0, image[f]), hole[f])), 0, 255) for f in range(2)}
    assert len(got) == 96 and all([r.r, r.g, r.b] == want[r.frame][r.y, r.x].tolist() for r in got)
