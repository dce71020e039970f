"""Queries of the channel, neighbourhood, camera, loss and listing operators over the views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framelake import functions as fn
from framelake.operators import evaluation as ev
from framelake.operators import features as ft
from framelake.operators import flow as fl
from framelake.operators import frames as fr
from framelake.operators import geometry as geo
from framelake.operators import images as im
from framelake.operators import losses as ls
from framelake.operators import marching as mi
from framelake.operators import resize as rs
from framelake.operators import temporal as tp
from framelake.plans import queries as q
from framelake.plans import views as v
from framelake.plans.registry import FOCAL, MOVE, PIXEL, nudged, nudged_sql, query, r6, r6s
from framelake.plans.views import DENSE, FR, GRID, MAN, PG, PX, H, W
from framelake.sources import manifest as mf
from framelake.sources import depth_maps, folders, rasters, sinks

# Channels and levels


@query("p01_from_bgr", f"WITH {PX} SELECT video, frame, y, x, round(b / 255.0, 6) AS r, round(g / 255.0, 6) AS g, round(r / 255.0, 6) AS b, round((b / 255.0 - 0.485) / 0.229, 6) AS standard FROM px")
def p01(spark, sf):
    rgb = im.from_bgr(v.pixels(spark, sf))
    return rgb.select(*PIXEL, *r6s("r", "g", "b"), r6(fn.standardise(F.col("r"), *fn.CHANNEL_STATISTICS["r"]), "standard"))


@query("p13_low_width", f"WITH {q._SIZES}, l AS (SELECT *, CAST(round_even(w * 294 / CAST(h AS DOUBLE), 0) AS INTEGER) AS lw FROM sz) SELECT p_partkey, lw - lw % 2 AS low_w, round(24.0::DOUBLE * (lw - lw % 2) / w, 6) AS disparity FROM l")
def p13(spark, sf):
    low = q.sizes(spark, sf).withColumn("low_w", rs.low_width(F.col("h"), F.col("w"), 294))
    return low.select("p_partkey", "low_w", r6(rs.low_disparity(24.0, F.col("w"), F.col("low_w")), "disparity"))


def _anchors(c: int) -> str:
    return "[" + ", ".join(f"{a[c]}.0::DOUBLE" for a in im.SPECTRAL) + "]"


@query("p17_colours", f"WITH {q._MINMAX}, l AS (SELECT video, frame, y, x, floor(norm * 255) / 255.0::DOUBLE * 10 AS pos FROM mm), i AS (SELECT *, CAST(least(floor(pos), 9) AS INTEGER) AS i FROM l) SELECT video, frame, y, x, " + ", ".join(nudged_sql(f"({_anchors(k)}[i + 1] * (1 - (pos - i)) + {_anchors(k)}[i + 2] * (pos - i)) / 255.0", c) for k, c in enumerate("rgb")) + " FROM i")
def p17(spark, sf):
    levels = fr.minmax_normalise(v.pixels(spark, sf)).withColumn("level", fn.quantise(F.col("norm")))
    return im.coloured(levels.select(*PIXEL, "level"), im.colour_table(spark)).select(*PIXEL, *[nudged(c, c) for c in "rgb"])


@query("p18_gray", f"WITH {PX} SELECT video, frame, y, x, g AS r, g AS g, g AS b FROM px")
def p18(spark, sf):
    return im.gray(v.pixels(spark, sf), F.col("g"))


@query("p36_output_levels", f"WITH {PX}, t AS (SELECT video, frame, max(g) <= 1 AS unit FROM px GROUP BY 1, 2) SELECT video, frame, y, x, CAST(round_even(least(greatest(CASE WHEN unit THEN g * 255.0::DOUBLE ELSE g END, 0.0), 255.0), 0) AS INTEGER) AS level FROM px JOIN t USING (video, frame)")
def p36(spark, sf):
    return im.output_levels(v.pixels(spark, sf), "g").select(*PIXEL, "level")


@query("p35_channels_first", f"WITH {PX}, c AS (SELECT video, frame, y, x, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS value FROM px) SELECT video, frame, y, CAST(row_number() OVER (PARTITION BY video, frame, y ORDER BY c, x) - 1 AS INTEGER) AS i, value FROM c")
def p35(spark, sf):
    rows = v.pixels(spark, sf).groupBy("video", "frame", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.array("r", "g", "b").alias("c")))).alias("p"))
    packed = im.channels_first(F.flatten(F.transform("p", lambda p: p["c"])))
    return rows.select("video", "frame", "y", F.posexplode(packed).alias("i", "value"))


@query("p34_pixel_grid", f"WITH {PX}, {GRID} SELECT video, frame, y, x, CAST(x AS DOUBLE) AS gx, CAST(y AS DOUBLE) AS gy, 1.0::DOUBLE AS gz, 1.0::DOUBLE AS gw FROM grid")
def p34(spark, sf):
    return im.pixel_grid(v.pixels(spark, sf), H, W)


@query("p31_flip_and_roll", f"WITH {PX} SELECT video, CAST((frame + 6) % 7 AS INTEGER) AS frame, y, CAST({W - 1} - x AS INTEGER) AS x, depth FROM px")
def p31(spark, sf):
    return im.rolled(im.flipped(v.pixels(spark, sf), W), 7).select("video", F.col("frame").cast("int").alias("frame"), "y", "x", "depth")


@query("p37_trim_crop", f"WITH {PX} SELECT video, frame, y, x, r FROM px WHERE y < {H - 5} AND x < {W - 5}")
def p37c(spark, sf):
    return im.trimmed_right(v.pixels(spark, sf), 5, H, W, "crop").select(*PIXEL, "r")


@query("p37_trim_blank", f"WITH {PX} SELECT video, frame, y, x, CASE WHEN y >= {H - 5} AND x >= {W - 5} THEN 0.0 ELSE r END AS r FROM px")
def p37b(spark, sf):
    return im.trimmed_right(v.pixels(spark, sf), 5, H, W, "blank").select(*PIXEL, "r")


@query("p38_refined", f"WITH {PX}, {DENSE} SELECT video, frame, CAST(y * 2 + j AS INTEGER) AS y, CAST(x * 2 + i AS INTEGER) AS x, {nudged_sql('(depth / 200000.0::DOUBLE + 0.001) * 200000.0::DOUBLE', 'depth', 3)} FROM dense, (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS i)")
def p38(spark, sf):
    return im.refined(q.dense_pixels(spark, sf), F.lit(0.001), 0.0, 200000.0).select(*PIXEL, nudged("depth", "depth", 3))


def _pad(mode, value):
    @query(f"p39_crop_and_pad_{mode}", f"WITH {PX}, {DENSE} SELECT g.video, g.frame, g.y, g.x, {value} AS depth FROM grid g JOIN dense d ON d.video = g.video AND d.frame = g.frame AND d.y = least(greatest(g.y - 4, 0), 23) + 4 AND d.x = least(greatest(g.x - 2, 0), 59) + 2")
    def run(spark, sf):
        cropped, top, left = im.centre_cropped(q.dense_pixels(spark, sf), H, W, 12)
        return im.padded_back(cropped, H, W, 24, 60, top, left, mode).select(*PIXEL, "depth")


_pad("replicate", "d.depth")
_pad("constant", "CASE WHEN d.y = g.y AND d.x = g.x THEN d.depth ELSE 0.0 END")


@query("p40_confidence_gate", f"WITH {PX} SELECT video, frame, y, x, CASE WHEN 1 - g < 0.95 THEN 0.0 ELSE depth END AS depth FROM px")
def p40(spark, sf):
    return im.confidence_gate(v.pixels(spark, sf), 1 - F.col("g"), 0.95).select(*PIXEL, "depth")


@query("p42_mask_levels", f"WITH {PX}, {DENSE} SELECT video, frame, y, x, CASE WHEN hole THEN 255 ELSE 0 END AS level FROM dense")
def p42(spark, sf):
    return im.mask_levels(fr.with_holes(v.pixels(spark, sf), H, W))


@query("f06_background", f"WITH {PX}, {DENSE} SELECT video, frame, CAST(count(*) FILTER (g <= 0.025 AND b <= 0.025) AS BIGINT) AS black, CAST(count(*) FILTER (g <= 0.025 AND b <= 0.025 AND depth = 0) AS BIGINT) AS background FROM dense GROUP BY 1, 2")
def f06(spark, sf):
    black = im.is_black(fn.balanced(F.col("g")), fn.balanced(F.col("b")))
    return q.dense_pixels(spark, sf).groupBy("video", "frame").agg(F.count(F.when(black, 1)).alias("black"), F.count(F.when(black & (F.col("depth") == 0), 1)).alias("background"))


@query("u04_mask_sets", f"WITH {PX} SELECT video, frame, CAST(count(*) FILTER (r > 25 OR g > 0.05) AS BIGINT) AS either, CAST(count(*) FILTER (r > 25 AND g > 0.05) AS BIGINT) AS both FROM px GROUP BY 1, 2")
def u04(spark, sf):
    a, b = F.col("r") > 25, F.col("g") > 0.05
    return fr.mask_sets(v.pixels(spark, sf), a, b)


@query("s09_ground_truth", f"WITH {PX}, {DENSE} SELECT video, frame, y, x, {nudged_sql('nullif(depth / 256.0::DOUBLE, 0)', 'gt')} FROM dense")
def s09(spark, sf):
    return q.dense_pixels(spark, sf).select(*PIXEL, nudged(ev.ground_truth(F.col("depth"), 256.0), "gt"))


@query("k03_clip_levels", f"WITH {PX} SELECT video, frame, y, x, CAST(floor((depth - lo) / (hi - lo) * 255) AS INTEGER) AS level FROM px JOIN (SELECT video, min(depth) AS lo, max(depth) AS hi FROM px GROUP BY 1) USING (video)")
def k03(spark, sf):
    return sinks.clip_normalised(v.pixels(spark, sf)).select(*PIXEL, "level")


@query("k05_ply_lines", f"WITH {PX} SELECT concat_ws(' ', CAST(CAST(x AS DOUBLE) AS VARCHAR), CAST(CAST(y AS DOUBLE) AS VARCHAR), CAST(depth AS VARCHAR), CAST(CAST(floor(least(greatest(r / 50, 0.0), 1.0) * 255) AS BIGINT) AS VARCHAR), CAST(CAST(floor(least(g, 1.0) * 255) AS BIGINT) AS VARCHAR), CAST(CAST(floor(least(b, 1.0) * 255) AS BIGINT) AS VARCHAR)) AS value FROM px")
def k05(spark, sf):
    return sinks.ply_lines(v.pixels(spark, sf).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("depth").alias("z"), (F.col("r") / 50).alias("r"), "g", "b"))


# Neighbourhoods


def _near_sql(offsets: str, columns: str) -> str:
    return f"WITH {PX}, o AS ({offsets}), n AS (SELECT a.video, a.frame, a.y, a.x, b.depth FROM px a CROSS JOIN o JOIN px b ON b.video = a.video AND b.frame = a.frame AND b.y = a.y + o.dy AND b.x = a.x + o.dx), s AS (SELECT video, frame, y, x, count(*) AS n, sum(depth) AS s, min(depth) AS least, max(depth) AS most FROM n GROUP BY 1, 2, 3, 4) SELECT px.video, px.frame, px.y, px.x, {columns} FROM px LEFT JOIN s USING (video, frame, y, x)"


_RING = lambda d: f"SELECT y * {d} AS dy, x * {d} AS dx FROM (SELECT unnest([-1, 0, 1]) AS y), (SELECT unnest([-1, 0, 1]) AS x)"


@query("r08_ones_convolution", _near_sql(_RING(1), f"CAST(n AS INTEGER) AS n, {nudged_sql('s', 'total', 2)}, {nudged_sql('s / n', 'mean', 4)}"))
def r08(spark, sf):
    near = im.with_neighbours(v.pixels(spark, sf), [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    total = F.aggregate("near", F.lit(0.0), lambda s, x: s + x)
    return near.select(*PIXEL, F.size("near").alias("n"), nudged(total, "total", 2), nudged(total / F.size("near"), "mean", 4))


@query("w14_propagation", _near_sql(f"SELECT * FROM ({_RING(2)}) WHERE dy <> 0 OR dx <> 0", "CAST(coalesce(n, 0) AS INTEGER) AS n, least, most"))
def w14(spark, sf):
    near = im.with_neighbours(v.pixels(spark, sf), im.propagation_offsets(8, 2))
    return near.select(*PIXEL, F.size("near").alias("n"), F.get("near", F.lit(0)).alias("least"), F.get("near", F.size("near") - 1).alias("most"))


@query("w18_evaluation_ring", _near_sql(f"({_RING(2)}) UNION ({_RING(4)})", f"CAST(n AS INTEGER) AS n, {nudged_sql('s / n', 'mean', 4)}"))
def w18(spark, sf):
    near = im.with_neighbours(v.pixels(spark, sf), im.evaluation_offsets(17, 3))
    return near.select(*PIXEL, F.size("near").alias("n"), nudged(F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / F.size("near"), "mean", 4))


@query("r10_upsampled", q._bilinear_sql(H, W, 2 * H, 2 * W, False))
def r10(spark, sf):
    return rs.bilinear(q.dense_pixels(spark, sf), H, W, 2 * H, 2 * W).select(*PIXEL, nudged("depth", "depth", 3))


def _flow_sql() -> str:
    """Frame after frame of the dense rasters: each joins the one before, smoothed, at four taps."""
    taps = ("y0", "x0"), ("y0", "x1"), ("y1", "x0"), ("y1", "x1")
    steps = [f"s1 AS (SELECT video, frame, y, x, depth FROM dense WHERE frame = 1)"]
    for k in range(2, 8):
        joins = " ".join(f"LEFT JOIN s{k - 1} t{i} ON t{i}.video = q.video AND t{i}.y = q.{y} AND t{i}.x = q.{x} AND q.inside" for i, (y, x) in enumerate(taps))
        steps.append(f"""s{k} AS (SELECT q.video, q.frame, q.y, q.x, CASE WHEN t0.depth IS NULL THEN q.depth ELSE 0.75::DOUBLE * q.depth + 0.25::DOUBLE * ((t0.depth * (1 - ax) + t1.depth * ax) * (1 - ay) + (t2.depth * (1 - ax) + t3.depth * ax) * ay) END AS depth
FROM (SELECT *, CAST(floor(qy / 32) AS INTEGER) AS y0, CAST(floor(qx / 32) AS INTEGER) AS x0, least(CAST(floor(qy / 32) AS INTEGER) + 1, {H - 1}) AS y1, least(CAST(floor(qx / 32) AS INTEGER) + 1, {W - 1}) AS x1, qx / 32 - floor(qx / 32) AS ax, qy / 32 - floor(qy / 32) AS ay
  FROM (SELECT *, round_even(fx * 32, 0) AS qx, round_even(fy * 32, 0) AS qy, fx > 0 AND fx < {W - 1} AND fy > 0 AND fy < {H - 1} AS inside FROM f WHERE frame = {k})) q {joins})""")
    return f"""WITH {PX}, {DENSE}, f AS (SELECT video, frame, y, x, depth, x + (r % 3 - 1) / 3.0::DOUBLE AS fx, y + g * 10 AS fy FROM dense), {', '.join(steps)}
SELECT video, frame, y, x, {nudged_sql('depth', 'depth', 4)} FROM ({' UNION ALL '.join(f'SELECT * FROM s{k}' for k in range(1, 8))})"""


@query("w02_flow_blend", _flow_sql())
def w02(spark, sf):
    grid = q.dense_pixels(spark, sf).withColumn("dx", (F.col("r") % 3 - 1) / 3.0).withColumn("dy", F.col("g") * 10)
    smoothed = tp.smooth_along_flow(tp.as_frames(grid, ("depth", "dx", "dy")), 0.75, H, W)
    return tp.as_pixels(smoothed, "depth", W).select(*PIXEL, nudged("depth", "depth", 4))


@query("c01_baseline_stereo")
def c01(spark, sf):
    return im.baseline_stereo(v.pixels(spark, sf), H, W, 12).select(*PIXEL, "r", "g", "b")


@query("w13_marching_inpaint")
def w13(spark, sf):
    return mi.marching_inpaint(fr.with_holes(v.pixels(spark, sf), H, W), H, W).select(*PIXEL, "r", "g", "b")


@query("c01_baseline_marched")
def c01_marched(spark, sf):
    return mi.baseline_stereo_marched(v.pixels(spark, sf), H, W, 12).select(*PIXEL, "r", "g", "b")


@query("r07_flow_smoothed")
def r07(spark, sf):
    """Flow of each frame's red channel from the one before, and depth smoothed along it."""
    frames = tp.as_frames(q.dense_pixels(spark, sf), ("r", "depth")).withColumnRenamed("r", "gray")
    return tp.as_pixels(tp.smooth_along_flow(fl.optical_flow(frames, H, W), 0.5, H, W), "depth", W)


# Cameras


@query("p19_camera_inverse", f"WITH {q._SIZES}, m AS (SELECT p_partkey, cos(h * 0.1::DOUBLE) AS c, sin(h * 0.1::DOUBLE) AS s, w / 100.0::DOUBLE AS tx, h / 100.0::DOUBLE AS ty, w, h FROM sz) SELECT p_partkey, round(s, 6) AS r01, round(-(c * tx + s * ty), 6) AS t0, round(s * tx - c * ty, 6) AS t1, -1.0::DOUBLE AS t2, round(1.0::DOUBLE / w, 6) AS ifx, round(-(w / 2.0::DOUBLE) / w, 6) AS icx FROM m")
def p19(spark, sf):
    a, zero, one = F.col("h") * 0.1, F.lit(0.0), F.lit(1.0)
    pose = [F.cos(a), -F.sin(a), zero, F.col("w") / 100.0, F.sin(a), F.cos(a), zero, F.col("h") / 100.0, zero, zero, one, one, zero, zero, zero, one]
    m = geo.invert_pose(pose)
    k = geo.invert_intrinsics(F.col("w"), F.col("h"), F.col("w") / 2, F.col("h") / 2)
    return q.sizes(spark, sf).select("p_partkey", r6(m[1], "r01"), r6(m[3], "t0"), r6(m[7], "t1"), r6(m[11], "t2"), r6(k[0], "ifx"), r6(k[2], "icx"))


@query("p23_depth_feature", f"WITH {PX}, {q._CAM} SELECT video, frame, y, x, round((1 / z) / (1 / least) * 2 - 1, 6) AS feature FROM z JOIN (SELECT video, frame, min(z) AS least FROM z GROUP BY 1, 2) USING (video, frame)")
def p23(spark, sf):
    px = q.z_pixels(spark, sf)
    least = px.groupBy("video", "frame").agg(F.min("z").alias("least"))
    return px.join(least, ["video", "frame"]).select(*PIXEL, r6(geo.geometry_feature(F.col("z"), F.col("least")), "feature"))


@query("p32_identity_camera", f"WITH {PX}, {q._CAM} SELECT video, frame, y, x, {nudged_sql('x * z', 'px')}, {nudged_sql('y * z', 'py')} FROM z")
def p32(spark, sf):
    cx, cy, _ = geo.identity_unproject(F.col("x"), F.col("y"), F.col("z"))
    return q.z_pixels(spark, sf).select(*PIXEL, nudged(cx, "px"), nudged(cy, "py"))


def _cameras(spark, sf):
    return q.sizes(spark, sf).select("p_partkey", "h", "w", F.col("w").cast("double").alias("fx"), F.col("h").cast("double").alias("fy"), (F.col("w") / 2.0).alias("cx"), (F.col("h") / 2.0).alias("cy"))


@query("p26_stage_intrinsics", f"WITH {q._SIZES}, s AS (SELECT *, unnest([0, 1, 2, 3]) AS stage FROM sz) SELECT p_partkey, stage, round(w * pow(0.5, stage), 6) AS fx, round(h * pow(0.5, stage), 6) AS fy, round((w / 2.0::DOUBLE - w % 8 // 2) * pow(0.5, stage), 6) AS cx, round((h / 2.0::DOUBLE - h % 8 // 2) * pow(0.5, stage), 6) AS cy FROM s")
def p26(spark, sf):
    start = lambda c: F.floor(F.col(c) % 8 / 2)
    return geo.stage_intrinsics(_cameras(spark, sf), start("w"), start("h")).select("p_partkey", "stage", *r6s("fx", "fy", "cx", "cy"))


@query("a45_mean_intrinsics", f"WITH {q._SIZES} SELECT p_partkey % 10 AS sample, round(avg(w), 6) AS fx, round(avg(h), 6) AS fy, round(avg(w / 2.0::DOUBLE), 6) AS cx, round(avg(h / 2.0::DOUBLE), 6) AS cy FROM sz GROUP BY 1")
def a45(spark, sf):
    return geo.mean_intrinsics(_cameras(spark, sf).withColumn("sample", F.col("p_partkey") % 10), ["sample"]).select("sample", *r6s("fx", "fy", "cx", "cy"))


_RANGE = f"{q._SIZES}, g AS (SELECT p_partkey, h / 100.0::DOUBLE AS near, h / 100.0::DOUBLE + w / 10.0::DOUBLE AS far FROM sz)"


@query("p27_hypotheses", f"WITH {_RANGE}, k AS (SELECT *, unnest(range(48)) AS k FROM g) SELECT p_partkey, CAST(k AS INTEGER) AS k, round(1 / (1 / far + (k + 0.5::DOUBLE) / 48 * (1 / near - 1 / far)), 6) AS depth FROM k")
def p27(spark, sf):
    near = F.col("h") / 100.0
    found = geo.depth_hypotheses(near, near + F.col("w") / 10.0, F.lit(0.5))
    return q.sizes(spark, sf).select("p_partkey", F.posexplode(found).alias("k", "d")).select("p_partkey", "k", r6("d", "depth"))


@query("p27_perturbed", f"WITH {_RANGE}, k AS (SELECT *, unnest(range(8)) AS k FROM g) SELECT p_partkey, CAST(k AS INTEGER) AS k, round(1 / least(greatest(1 / (near + 1) + (1 / near - 1 / far) * 0.025::DOUBLE * (k - 4), 1 / far), 1 / near), 6) AS depth FROM k")
def p27p(spark, sf):
    near = F.col("h") / 100.0
    found = geo.perturbed_hypotheses(near + 1, near, near + F.col("w") / 10.0, 0.025, 8)
    return q.sizes(spark, sf).select("p_partkey", F.posexplode(found).alias("k", "d")).select("p_partkey", "k", r6("d", "depth"))


@query("f10_inside_view", f"WITH {PX}, {q._CAM}, n AS (SELECT video, frame, (cx - 0.5) / (z + 0.5) * {FOCAL} / {W / 2} AS u, cy / (z + 0.5) * {FOCAL} / {H / 2} AS v FROM c) SELECT video, frame, CAST(count(*) FILTER (u BETWEEN -1 AND 1 AND v BETWEEN -1 AND 1) AS BIGINT) AS seen FROM n GROUP BY 1, 2")
def f10(spark, sf):
    cx, cy, cz = geo.unproject(F.col("x"), F.col("y"), F.col("z"), W, H, FOCAL)
    inside = im.inside_view((cx - 0.5) / (cz + 0.5) * FOCAL / (W / 2), cy / (cz + 0.5) * FOCAL / (H / 2))
    return q.z_pixels(spark, sf).groupBy("video", "frame").agg(F.count(F.when(inside, 1)).alias("seen"))


@query("a08_reprojected", f"""WITH {PX}, {q._CAM}, m AS (SELECT video, frame + 1 AS frame, y * {W} + x AS src, cx - {MOVE[0]} AS px, cy - {MOVE[1]} AS py, z - {MOVE[2]} AS pz FROM c),
u AS (SELECT *, CAST(round_even(px / pz * {FOCAL} + {W / 2}, 0) AS INTEGER) AS x, CAST(round_even(py / pz * {FOCAL} + {H / 2}, 0) AS INTEGER) AS y FROM m WHERE abs(pz) >= 0.01)
SELECT video, frame, y, x, {nudged_sql("max({'src': src, 'pz': pz}).pz", 'z')} FROM u WHERE x >= 0 AND x < {W} AND y >= 0 AND y < {H} GROUP BY 1, 2, 3, 4""")
def a08(spark, sf):
    return geo.reproject(q.z_pixels(spark, sf), 1, W, H, FOCAL, MOVE).select(*PIXEL, nudged("z", "z"))


# Losses


@query("a17_silog_loss", f"WITH {PG}, d AS (SELECT dataset, scene, ln(gt) - ln(pred) AS d FROM al) SELECT dataset, scene, round(sqrt(avg(d * d) - 0.5::DOUBLE * avg(d) * avg(d)), 6) AS loss FROM d GROUP BY 1, 2")
def a17(spark, sf):
    return ls.silog_loss(q.aligned(spark, sf)).select("dataset", "scene", r6("loss", "loss"))


def _procrustes_sql(trim: float, keys: str) -> str:
    """e to the table ``loss`` of ``keys``, over the pixels of e whose mask is true; images are frames."""
    return f"""mi AS (SELECT video, frame, quantile_disc(CASE WHEN mask THEN pred ELSE 0.0 END, 0.5) AS pm, quantile_disc(CASE WHEN mask THEN target ELSE 0.0 END, 0.5) AS tm FROM e GROUP BY 1, 2),
sp AS (SELECT video, frame, any_value(pm) AS pm, any_value(tm) AS tm, greatest(avg(abs(pred - pm)) FILTER (mask), 1e-6) AS ps, greatest(avg(abs(target - tm)) FILTER (mask), 1e-6) AS ts FROM e JOIN mi USING (video, frame) GROUP BY 1, 2),
nm AS (SELECT video, frame, y, x, (pred - pm) / ps - (target - tm) / ts AS diff FROM e JOIN sp USING (video, frame) WHERE mask),
rk AS (SELECT {keys}, abs(diff) AS res, row_number() OVER (PARTITION BY {keys} ORDER BY abs(diff)) AS rank, count(*) OVER (PARTITION BY {keys}) AS n FROM nm),
da AS (SELECT {keys}, sum(CASE WHEN rank <= floor(n * (1 - {trim}::DOUBLE)) THEN res ELSE 0.0 END) / max(n) AS data FROM rk GROUP BY ALL),
sm AS ({q.gradient_sql('nm', 'diff', keys, 'true')}),
loss AS (SELECT {keys}, data + 0.5::DOUBLE * sm.loss AS loss FROM da JOIN sm USING ({keys}))"""


@query("a26_trimmed_procrustes", f"WITH {q.RATED}, {_procrustes_sql(0.2, 'video, frame')} SELECT video, frame, round(loss, 6) AS loss FROM loss")
def a26(spark, sf):
    return ls.trimmed_procrustes(q.rated(spark, sf)).select("video", "frame", r6("loss", "loss"))


@query("a28_video_depth_loss", f"""WITH {q.RATED}, {_procrustes_sql(0.0, 'video')},
su AS (SELECT video, sum(pred * pred) AS pp, sum(pred) AS sp, CAST(count(*) AS DOUBLE) AS n, sum(pred * target) AS pt, sum(target) AS st FROM e WHERE mask GROUP BY 1),
ft AS (SELECT video, (n * pt - sp * st) / (pp * n - sp * sp + 1e-6) AS s, (-sp * pt + pp * st) / (pp * n - sp * sp + 1e-6) AS t FROM su),
al AS (SELECT video, frame, y, x, s * pred + t AS pred, target, mask FROM e JOIN ft USING (video)),
st AS ({q.temporal_sql('al', 1, 0.0, 'mask')})
SELECT video, round(loss.loss, 6) AS spatial, round(10 * st.loss, 6) AS stable, round(loss.loss + 10 * st.loss, 6) AS total FROM loss JOIN st USING (video)""")
def a28(spark, sf):
    return ls.video_depth_loss(q.rated(spark, sf)).select("video", *r6s("spatial", "stable", "total"))


@query("a31_split_psnr", f"WITH {q._NORM}, {q._RIGHT}, p AS (SELECT video, frame, 10.0 * log10(1 / avg((px.r - rp.r) * (px.r - rp.r) + (px.g - rp.g) * (px.g - rp.g) + (px.b - rp.b) * (px.b - rp.b))) AS psnr FROM px JOIN rp USING (video, frame, y, x) GROUP BY 1, 2) SELECT video, round(avg(psnr), 6) AS psnr_all, round(avg(psnr) FILTER (frame % 3 <> 1), 6) AS psnr_rest FROM p GROUP BY 1")
def a31(spark, sf):
    right = q.right_view(spark, sf).select(*PIXEL, *[F.col(c).alias(f"{c}2") for c in "rgb"])
    each = ev.psnr(v.pixels(spark, sf).join(right, PIXEL))
    return ls.split_means(each, ("psnr",), F.col("frame") % 3 == 1, ("video",)).select("video", *r6s("psnr_all", "psnr_rest"))


@query("a38_combined_loss", f"WITH {PG}, l AS (SELECT dataset, scene, avg(abs(pred - gt)) AS l1, avg((pred - gt) * (pred - gt)) AS l2 FROM al GROUP BY 1, 2) SELECT dataset, scene, round(l1 + 10 * l2, 6) AS total FROM l")
def a38(spark, sf):
    d = F.col("pred") - F.col("gt")
    each = q.aligned(spark, sf).groupBy("dataset", "scene").agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("l2"))
    return ls.combined(each, ["5.0_l1", "10.0_l2"]).select("dataset", "scene", r6("total", "total"))


# Features


@query("a48_rescaled_guidance", f"WITH {q._VEC}, s AS (SELECT vec_id, v, list_aggregate(v[33:64], 'stddev_samp') / list_aggregate(v[1:32], 'stddev_samp') AS ratio FROM e) SELECT vec_id, round(0.7::DOUBLE * v[1] * ratio + (1 - 0.7::DOUBLE) * v[1], 6) AS first, round(0.7::DOUBLE * v[32] * ratio + (1 - 0.7::DOUBLE) * v[32], 6) AS last FROM s")
def a48(spark, sf):
    out = ft.rescaled_guidance(F.slice("v", 1, 32), F.slice("v", 33, 32), 0.7)
    return q.vectors(spark, sf).withColumn("o", out).select("vec_id", r6(F.get("o", F.lit(0)), "first"), r6(F.get("o", F.lit(31)), "last"))


@query("a50_batch_normalised", f"WITH {q._VEC}, p AS (SELECT vec_id, unnest(v) AS c, unnest(range(64)) AS i FROM e), m AS (SELECT i, avg(c) AS m, 2.0::DOUBLE / sqrt(avg(c * c) - avg(c) * avg(c) + 1e-5::DOUBLE) AS s FROM p GROUP BY 1) SELECT vec_id, CAST(i AS INTEGER) AS i, round(c * s + (0.5::DOUBLE - m * s), 6) AS value FROM p JOIN m USING (i)")
def a50(spark, sf):
    return ft.batch_normalised(q.vectors(spark, sf).select("vec_id", "v"), "v", 2.0, 0.5).select("vec_id", "i", r6("v", "value"))


@query("a51_blended", f"WITH {q._VEC}, c AS (SELECT vec_id, unnest(v[1:4]) AS l, unnest(v[5:8]) AS value FROM e) SELECT vec_id, round(sum(exp(l) * value) / sum(exp(l)), 6) AS value FROM c GROUP BY 1")
def a51(spark, sf):
    return q.vectors(spark, sf).select("vec_id", r6(ft.blended(F.slice("v", 1, 4), F.slice("v", 5, 4)), "value"))


# Time and listings


@query("w09_dyadic_differences", f"WITH {FR}, s AS (SELECT *, unnest([1, 2, 4]) AS stride FROM fr), d AS (SELECT video, stride, idx, value - lag(value) OVER (PARTITION BY video, stride ORDER BY idx) AS step FROM s WHERE idx % stride = 0) SELECT video, stride, idx, {nudged_sql('step', 'step')} FROM d WHERE step IS NOT NULL")
def w09(spark, sf):
    return tp.dyadic_differences(v.frame_stream(spark, sf)).select("video", "stride", "idx", nudged("step", "step"))


@query("w17_running_mean", f"WITH {FR} SELECT video, idx, {nudged_sql('avg(value) OVER (PARTITION BY video ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'mean')} FROM fr")
def w17(spark, sf):
    return tp.running_mean(v.frame_stream(spark, sf)).select("video", "idx", nudged("mean", "mean"))


@query("j04_next_frame", f"WITH {MAN}, n AS (SELECT dataset, gt_depth, image, lead(image) OVER (PARTITION BY dataset ORDER BY gt_depth) AS next_image FROM man) SELECT * FROM n WHERE next_image IS NOT NULL")
def j04(spark, sf):
    return tp.next_frames(v.manifest_rows(spark, sf), ["dataset"], "image", "gt_depth")


@query("j02_prediction_and_truth", f"WITH {MAN} SELECT a.dataset, a.scene, a.frame, a.image, round(b.factor, 6) AS factor FROM man a JOIN man b ON b.dataset = a.dataset AND b.scene = a.scene AND b.gt_depth = regexp_replace(a.image, '\\.(jpg|png)$', '.npy')")
def j02(spark, sf):
    rows = v.manifest_rows(spark, sf)
    predicted = rows.select("dataset", "scene", "frame", "image", fn.swap_suffix(F.col("image")).alias("gt_depth"))
    return predicted.join(rows.select("dataset", "scene", "gt_depth", "factor"), ["dataset", "scene", "gt_depth"]).select("dataset", "scene", "frame", "image", r6("factor", "factor"))


@query("j12_strict_zip", "WITH a AS (SELECT s_nationkey AS nation, s_name AS image, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS place FROM supplier), b AS (SELECT s_nationkey AS nation, s_suppkey AS depth, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS place FROM supplier) SELECT nation, CAST(place AS INTEGER) AS place, image, depth FROM a JOIN b USING (nation, place)")
def j12(spark, sf):
    s = v.table(spark, sf, "supplier")
    left, right = s.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("image")), s.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("depth"), "s_acctbal")
    return mf.positional_zip(left, right, ["nation"], F.col("image"), F.struct("s_acctbal", "depth"), strict=True).select("nation", "place", "image", "depth")


@query("o03_digit_sort", f"WITH {MAN} SELECT dataset, scene, image, CAST(row_number() OVER (PARTITION BY dataset, scene ORDER BY CAST(right(regexp_replace(image, '\\.[^.]*$', ''), 4) AS INTEGER), image) AS INTEGER) AS place FROM man")
def o03(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("dataset", "scene").orderBy(fn.last_digits_key(F.col("image")), "image")
    return v.manifest_rows(spark, sf).select("dataset", "scene", "image", F.row_number().over(order).alias("place"))


@query("o08_sampled_views", f"WITH {MAN}, r AS (SELECT dataset, scene, image, row_number() OVER (PARTITION BY dataset, scene ORDER BY md5(concat_ws(':', 'views', dataset, scene, image)), image) AS r FROM man) SELECT dataset, scene, image FROM r WHERE r <= 3")
def o08(spark, sf):
    return tp.sampled_views(v.manifest_rows(spark, sf), ["dataset", "scene"], "image", 3).select("dataset", "scene", "image")


@query("f11_suffix_filter", "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%.html'")
def f11(spark, sf):
    return v.table(spark, sf, "pages").filter(fn.suffix(F.col("url")) == ".html").select("page_id", "url")


@query("u01_bag_union", f"WITH {MAN} SELECT scene, image AS path FROM man UNION ALL SELECT scene, gt_depth FROM man UNION ALL SELECT scene, image FROM man WHERE frame % 2 = 0")
def u01(spark, sf):
    rows = v.manifest_rows(spark, sf)
    images = rows.select("scene", F.col("image").alias("path"))
    return images.unionByName(rows.select("scene", F.col("gt_depth").alias("path"))).unionByName(rows.filter("frame % 2 = 0").select("scene", F.col("image").alias("path")))


@query("s18_paired_images", "SELECT n_name AS split, CAST(s_suppkey AS VARCHAR) AS image_id, s_name || '.png' AS image, s_name || '_t.png' AS target_image, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '_r.png' END AS ref_image FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0")
def s18(spark, sf):
    s = v.table(spark, sf, "supplier").join(v.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    named = lambda tail: F.concat("s_name", F.lit(tail))
    entry = F.struct(named(".png").alias("image"), F.when(F.col("s_acctbal") >= 0, named("_t.png")).alias("target_image"), F.when(F.col("s_suppkey") % 2 == 0, named("_r.png")).alias("ref_image"))
    splits = s.groupBy("n_name").agg(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("k"), entry.alias("v")))).alias("m"))
    documents = splits.select(F.to_json(F.map_from_entries(F.array(F.struct(F.col("n_name"), F.col("m"))))).alias("json"))
    return mf.flatten_pairs(documents).select("split", "image_id", "image", "target_image", "ref_image")


@query("t02_stream_attended", f"WITH {q._LEN}, t AS (SELECT video, unnest(range(1, n)) AS idx FROM ln WHERE n > 1), s AS (SELECT *, unnest(range(31)) AS j FROM t) SELECT CAST(video AS BIGINT) AS video, CAST(idx AS BIGINT) AS idx, CAST(j AS INTEGER) AS slot, CAST(CASE WHEN j = 0 THEN 0 WHEN j = 1 THEN greatest(idx - 41, 0) ELSE greatest(idx - (31 - j), 0) END AS BIGINT) AS frame FROM s")
def t02(spark, sf):
    from framelake.plans.streams import attended_events, stream_folder

    out = attended_events(spark, sf, stream_folder(spark))
    return out.select("video", "idx", F.posexplode("attended").alias("slot", "frame"))


@query("t02_stream_states", f"""WITH {q.FR}, {q._LEN}, t AS (SELECT video, unnest(range(1, n)) AS idx FROM ln WHERE n > 1), s AS (SELECT *, unnest(range(31)) AS j FROM t),
a AS (SELECT video, idx, CASE WHEN j = 0 THEN 0 WHEN j = 1 THEN greatest(idx - 41, 0) ELSE greatest(idx - (31 - j), 0) END AS frame FROM s),
m AS (SELECT a.video, a.idx, avg(fr.value) AS mean FROM a JOIN fr ON fr.video = a.video AND fr.idx = a.frame GROUP BY 1, 2)
SELECT CAST(fr.video AS BIGINT) AS video, CAST(fr.idx AS BIGINT) AS idx, {nudged_sql('(fr.value + coalesce(m.mean, fr.value)) / 2', 'out')} FROM fr LEFT JOIN m USING (video, idx)""")
def t02_states(spark, sf):
    from framelake.plans.streams import remembered_events, stream_folder

    return remembered_events(spark, sf, stream_folder(spark)).select("video", "idx", nudged("out", "out"))


@query("t07_stream_windows", f"""WITH {q.FR}, {q._LEN}, w AS (SELECT video, n, unnest(range(CAST(ceil(n / 22.0) AS BIGINT))) AS k FROM ln), s AS (SELECT *, unnest(range(32)) AS j FROM w),
f AS (SELECT video, k, j, CASE WHEN k > 0 AND j = 0 THEN 0 WHEN k > 0 AND j = 1 THEN 22 * k - 10 ELSE least(22 * k + j, n - 1) END AS idx FROM s)
SELECT CAST(f.video AS BIGINT) AS video, CAST(k AS BIGINT) AS "window", CAST(j AS INTEGER) AS slot, CAST(f.idx AS BIGINT) AS frame, round(fr.value, 6) AS value FROM f JOIN fr ON fr.video = f.video AND fr.idx = f.idx""")
def t07(spark, sf):
    from framelake.plans.streams import count_windows_of_events, stream_folder

    return count_windows_of_events(spark, sf, stream_folder(spark)).select("video", "window", "slot", "frame", F.round("value", 6).alias("value"))


#: Levels, cut to whole numbers, of the dense raster as 8-bit gray PNGs, read back as predicted depth.
@query("s08_predicted_depth", f"""WITH {PX}, {DENSE} SELECT video, frame, y, x, CAST(floor(r) * 255 AS DOUBLE) AS depth FROM dense""")
def s08(spark, sf):
    images = depth_maps.png_images(_frame_rows(spark, sf, "r"))
    return _pixel_rows(depth_maps.predicted_depth(_as_files(images)), "depth")


#: Raw depth of 16 bits, which forgets whole multiples of 65,536, read back over its factor, -1 in holes.
@query("k06_png_true_depth", f"""WITH {PX}, {DENSE}, k AS (SELECT *, CAST(floor(depth) AS BIGINT) % 65536 / 256.0::DOUBLE AS gt FROM dense) SELECT video, frame, y, x, CASE WHEN gt = 0 THEN -1.0::DOUBLE ELSE gt END AS gt FROM k""")
def k06(spark, sf):
    images = depth_maps.png_images(_frame_rows(spark, sf, "depth"), bits=16)
    return _pixel_rows(depth_maps.true_depth(_as_files(images).withColumn("factor", F.lit(256.0))), "gt")


# Levels of the dense raster as files of a kind, and back.

_LEVELS = f"WITH {PX}, {DENSE} SELECT video, frame, y, x, CAST(r AS DOUBLE) AS level FROM dense"


def _round_trip(name, kind):
    @query(name, _LEVELS)
    def run(spark, sf):
        content = folders.file_bytes(_frame_rows(spark, sf, "r"), kind)
        return _pixel_rows(rasters.decode_files(content.select(F.concat("path", F.lit(f".{kind}")).alias("path"), "content")), "level")


_round_trip("s10_dpt_frames", "dpt")
_round_trip("s11_pfm_frames", "pfm")
_round_trip("s14_npy_frames", "npy")


def _written(spark, sf):
    """A folder that the sink has written the frames to, a file each; the shared folder must be mounted."""
    from framelake.plans.streams import stream_folder

    spark.dataSource.register(folders.RasterFolder)
    folder = f"{folders.local(stream_folder(spark))}/{uuid.uuid4()}"
    frames = _frame_rows(spark, sf, "r").withColumn("path", F.concat("path", F.lit(".npy")))
    frames.withColumn("values", F.col("values").cast("array<float>")).write.format("raster_folder").option("kind", "npy").mode("append").save(f"{folder}/frames")
    return folder


def _named(found):
    """The path below the folder again."""
    return found.withColumn("path", F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)))


@query("k04_written_frames", _LEVELS)
def k04(spark, sf):
    return _pixel_rows(_named(spark.read.format("raster_folder").load(f"{_written(spark, sf)}/frames")), "level")


@query("s04_streamed_frames", _LEVELS)
def s04(spark, sf):
    """The same files as a stream, at most eight to a batch."""
    folder = _written(spark, sf)
    stream = spark.readStream.format("raster_folder").option("files_per_batch", 8).option("progress", f"{folder}/progress.json").load(f"{folder}/frames")
    query_ = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    try:
        query_.processAllAvailable()
    finally:
        query_.stop()
    return _pixel_rows(_named(spark.read.parquet(f"{folder}/out")), "level")


def _frame_rows(spark, sf, value):
    """path, h, w, channels, values of each frame; the path says which."""
    frames = tp.as_frames(q.dense_pixels(spark, sf), (value,))
    return frames.select(F.concat_ws("/", "video", F.col("idx").cast("string")).alias("path"), F.lit(H).alias("h"), F.lit(W).alias("w"), F.lit(1).alias("channels"), F.col(value).alias("values"))


def _as_files(images):
    return images.select(F.concat("path", F.lit(".png")).alias("path"), "content")


def _pixel_rows(rasters_, name):
    at = F.split(F.regexp_replace("path", "[.][a-z]+$", ""), "/")
    named = rasters_.select(at[0].alias("video"), at[1].cast("int").alias("frame"), "h", "w", "channels", "values")
    return rasters.to_pixels(named, out=name).select(*PIXEL, name)
