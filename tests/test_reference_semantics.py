"""Losses, alignment, smoothing and orders against plain numpy, with masks, noise and ragged frames."""

import math

import numpy as np
import pytest

from framelake import functions as fn
from framelake.operators import evaluation as ev
from framelake.operators import frames as fr
from framelake.operators import losses as ls
from framelake.operators import temporal as tp

RNG = np.random.default_rng(11)
T, H, W = 6, 9, 11


def clip(masked=0.3):
    """pred, target (T, H, W) and a mask; the last frame has none of its pixels known."""
    target = np.cumsum(RNG.normal(size=(T, H, W)) * 0.05, axis=0) + RNG.random((H, W)) * 4
    pred = 0.7 * target + 0.3 + RNG.normal(size=(T, H, W)) * 0.1
    mask = RNG.random((T, H, W)) >= masked
    mask[-1] = False
    return pred, target, mask


def rows(spark, pred, target, mask):
    cells = [("v", t + 3, y, x, float(pred[t, y, x]), float(target[t, y, x]), bool(mask[t, y, x])) for t in range(T) for y in range(H) for x in range(W)]
    return spark.createDataFrame(cells, "video string, frame int, y int, x int, pred double, target double, mask boolean").repartition(3)


def gradient(diff, mask, frame_h=None):
    """Of a batch (n, h, w): per stride, all differences between known neighbours over all known pixels."""
    total = 0.0
    for s in (1, 2, 4, 8):
        d, m = diff[:, ::s, ::s], mask[:, ::s, ::s]
        losses = 0.0
        for n in range(d.shape[0]):
            for y in range(d.shape[1]):
                for x in range(d.shape[2]):
                    if x and m[n, y, x] and m[n, y, x - 1]:
                        losses += abs(d[n, y, x] - d[n, y, x - 1])
                    if y and m[n, y, x] and m[n, y - 1, x] and (not frame_h or y * s // frame_h == (y - 1) * s // frame_h):
                        losses += abs(d[n, y, x] - d[n, y - 1, x])
        total += losses / m.sum() if m.sum() else 0.0
    return total


def trimmed(error, mask, trim):
    e = np.sort(np.abs(error[mask]))
    return e[: int(len(e) * (1 - trim))].sum() / mask.sum() if mask.any() else 0.0


def normalised(x, mask):
    out = np.empty_like(x)
    for t in range(len(x)):
        if not mask[t].any():
            out[t] = x[t]
            continue
        entered = np.sort(np.where(mask[t], x[t], 0).ravel())
        middle = entered[(len(entered) - 1) // 2]
        out[t] = (x[t] - middle) / max(np.abs(x[t] - middle)[mask[t]].mean(), 1e-6)
    return out


def procrustes(pred, target, mask, alpha, trim):
    p, t = normalised(pred, mask), normalised(target, mask)
    return trimmed(p - t, mask, trim) + alpha * gradient(p - t, mask)


def temporal(pred, target, mask, scales, trim):
    spans = [(np.where(m, t, -np.inf).max() - np.where(m, t, np.inf).min()) * 0.05 if m.any() else -np.inf for t, m in zip(target, mask, strict=True)]
    total, count = 0.0, 0
    for i in range(scales):
        s = 2**i
        if s < len(pred):
            dp, dt = np.diff(pred[::s], axis=0), np.diff(target[::s], axis=0)
            both = mask[::s][1:] & mask[::s][:-1] & (np.abs(dt) < np.array(spans)[::s][1:, None, None])
            total, count = total + trimmed(dp - dt, both, trim) * 0.5**i, count + 1
    return total / count


def fit(p, t, mask):
    a = np.stack([p[mask], np.ones(mask.sum())], axis=1)
    return np.linalg.lstsq(a, t[mask], rcond=None)[0]


@pytest.mark.parametrize("trim", [0.0, 0.2])
def test_procrustes_by_frame_and_pooled(spark, trim):
    pred, target, mask = clip()
    px = rows(spark, pred, target, mask)
    pooled = ls.trimmed_procrustes(px, 0.5, trim, ("video",)).first().loss
    assert math.isclose(pooled, procrustes(pred, target, mask, 0.5, trim), rel_tol=1e-9)
    each = {r.frame: r.loss for r in ls.trimmed_procrustes(px, 0.5, trim).collect()}
    for t in range(T):
        assert math.isclose(each[t + 3], procrustes(pred[t : t + 1], target[t : t + 1], mask[t : t + 1], 0.5, trim), rel_tol=1e-9)
    assert each[T + 2] == 0


def test_gradient_reductions(spark):
    pred, target, mask = clip()
    px = rows(spark, pred, target, mask).selectExpr("*", "pred - target AS diff")
    assert math.isclose(ev.gradient_loss(px, keys=("video",), mask="mask").first().loss, gradient(pred - target, mask), rel_tol=1e-9)
    image = np.mean([gradient((pred - target)[t : t + 1], mask[t : t + 1]) for t in range(T)])
    assert math.isclose(ev.gradient_loss(px, keys=("video",), mask="mask", reduction="image").first().loss, image, rel_tol=1e-9)
    stacked = ev.gradient_loss(px, keys=("video",), mask="mask", frame_h=4).first().loss
    assert math.isclose(stacked, gradient(pred - target, mask, 4), rel_tol=1e-9) and stacked != image


def test_temporal_gradient(spark):
    pred, target, mask = clip()
    px = rows(spark, pred, target, mask)
    for scales, trim in ((4, 0.2), (1, 0.0), (2, 0.5)):
        got = ev.temporal_gradient_loss(px, scales, trim=trim, mask="mask").first().loss
        want = temporal(pred, target, mask, scales, trim)
        assert want > 0 and math.isclose(got, want, rel_tol=1e-9)
    assert ev.temporal_gradient_loss(px.filter("frame = 3"), mask="mask").count() == 0


def test_whole_video_loss(spark):
    pred, target, mask = clip()
    row = ls.video_depth_loss(rows(spark, pred, target, mask)).first()
    scale, shift = fit(pred, target, mask)
    spatial, stable = procrustes(pred, target, mask, 0.5, 0.0), 10 * temporal(scale * pred + shift, target, mask, 1, 0.0)
    assert math.isclose(row.spatial, spatial, rel_tol=1e-6) and math.isclose(row.stable, stable, rel_tol=1e-4) and math.isclose(row.total, spatial + stable, rel_tol=1e-4)
    ragged = rows(spark, pred, target, mask).filter("mask OR frame < 6")
    assert ls.video_depth_loss(ragged).first().total > 0


def test_scale_shift_takes_known_pixels(spark):
    pred, target, mask = clip()
    row = ev.scale_shift(rows(spark, pred, target, mask), ("video",), "pred", "target", "mask").first()
    assert np.allclose([row.infer_scale, row.infer_shift], fit(pred, target, mask))


def chain(windows):
    """Window by window, with noise: the first frame as predicted stays an anchor for good."""
    out, anchors = list(windows[0]), [windows[0][0], windows[0][12]]
    for w in windows[1:]:
        s, b = np.linalg.lstsq(np.stack([np.concatenate([w[0], w[1]]), np.ones(2 * len(w[0]))], axis=1), np.concatenate(anchors), rcond=None)[0]
        moved = np.clip(w * s + b, 0, None)
        for j, k in enumerate(np.linspace(0, 1, 8)):
            out[j - 8] = out[j - 8] * (1 - k) + moved[2 + j] * k
        out += list(moved[10:])
        anchors = [anchors[0], moved[12]]
    return np.array(out)


def test_alignment_chain_with_noise(spark):
    given = RNG.random((4, 32, 5)) * 3 + np.arange(4)[:, None, None]
    assert np.allclose(tp.alignment_chain(given, 90), chain(given)[:90])
    n = 70
    lengths = spark.createDataFrame([("a", n), ("b", 5)], "video string, n int")
    made = tp.windows(lengths).selectExpr("*", "abs(xxhash64(video, window, slot)) % 1000 / 100.0 AS value")
    got = tp.align_windows(made).toPandas()
    assert sorted(got.groupby("video").size().items()) == [("a", n), ("b", 5)]
    values = made.filter("video = 'a'").toPandas().sort_values(["window", "slot"]).value.to_numpy(dtype=float).reshape(-1, 32, 1)
    assert np.allclose(got[got.video == "a"].sort_values("frame").value, chain(values)[:n, 0])


def test_smoothing_along_flow(spark):
    depth, flow = RNG.random((5, 6, 8)) * 9, RNG.normal(size=(5, 2, 6, 8)) * 2
    want = [depth[0]]
    for t in range(1, 5):
        now = depth[t].copy()
        for y in range(6):
            for x in range(8):
                fx, fy = x + flow[t, 0, y, x], y + flow[t, 1, y, x]
                if 0 < fx < 7 and 0 < fy < 5:
                    fx, fy = round(fx * 32) / 32, round(fy * 32) / 32
                    x0, y0 = math.floor(fx), math.floor(fy)
                    taps = [(y0, x0, (1 - fx + x0) * (1 - fy + y0)), (y0, x0 + 1, (fx - x0) * (1 - fy + y0)), (y0 + 1, x0, (1 - fx + x0) * (fy - y0)), (y0 + 1, x0 + 1, (fx - x0) * (fy - y0))]
                    now[y, x] = 0.6 * now[y, x] + 0.4 * sum(want[-1][j, i] * k for j, i, k in taps if k)
        want.append(now)
    frames = [(v, t, *(a.ravel().tolist() for a in (depth[t], flow[t, 0], flow[t, 1]))) for v in ("a", "b") for t in range(5)]
    df = spark.createDataFrame(frames, "video string, idx int, depth array<double>, dx array<double>, dy array<double>").repartition(4)
    got = {(r.video, r.idx): np.reshape(r.depth, (6, 8)) for r in tp.smooth_along_flow(df, 0.6, 6, 8).collect()}
    assert len(got) == 10 and all(np.allclose(got[v, t], want[t]) for v in ("a", "b") for t in range(5))


def test_natural_order(spark):
    paths = [f"scene{s:04d}_00/color/{i}.jpg" for s in (707, 12) for i in (1, 2, 9, 10, 11, 100)] + ["a", "a1", "a01", "a1b", "a10", "a2", "", "7", "b" + "9" * 30, "b" + "8" * 31]
    want = ["", "7", "a", "a01", "a1", "a1b", "a2", "a10", "b" + "9" * 30, "b" + "8" * 31]
    want += [f"scene{s:04d}_00/color/{i}.jpg" for s in (12, 707) for i in (1, 2, 9, 10, 11, 100)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(p,) for p in reversed(paths)], "p string")
    assert [r.p for r in df.orderBy(fn.natural_key(F.col("p"))).collect()] == want


def test_sequential_fill_leaves_out_the_first_row_and_column():
    image = np.arange(16).reshape(4, 4, 1).repeat(3, axis=2) * 10
    hole = np.zeros((4, 4), dtype=bool)
    hole[0, 1] = hole[2, 2] = hole[0, 0] = True
    out = fr.sequential_fill(image, hole, 3)[..., 0]
    assert out[0, 0] == 50 and out[0, 1] == (50 + 60) // 2
    assert out[2, 2] == (50 + 60 + 70 + 90 + 110 + 130 + 140 + 150) // 8
    only = np.ones((3, 3), dtype=bool)
    only[0] = False
    assert (fr.sequential_fill(np.full((3, 3, 3), 7), only, 3)[1:] == 7).all()  # nothing known that counts: as it was
