"""Queries of whole encodings, general inverses, weighted views, running moments, nested timings and both eyes' edges."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from framelake import functions as fn
from framelake.operators import evaluation as ev
from framelake.operators import features as ft
from framelake.operators import frames as fr
from framelake.operators import geometry as geo
from framelake.operators import images as im
from framelake.operators import losses as ls
from framelake.operators import temporal as tp
from framelake.plans import queries as q
from framelake.plans import views as v
from framelake.plans.registry import PIXEL, nudged, nudged_sql, query, r6, r6s
from framelake.plans.views import DENSE, FR, MAN, H, W
from framelake.sources import manifest as mf


def z6(c, name: str):
    """Rounded, and without a sign where that gives 0."""
    return F.when(F.abs(c) < 5e-7, 0.0).otherwise(F.round(c, 6)).alias(name)


def z6_sql(c: str, name: str) -> str:
    return f"CASE WHEN abs({c}) < 5e-7 THEN 0.0::DOUBLE ELSE round({c}, 6) END AS {name}"


# Encodings and matrices

_COMPONENTS = f"{q._VEC}, p AS (SELECT vec_id, v, unnest(range(64)) AS i FROM e), t AS (SELECT *, pow(10000.0, -2.0 * (i // 2) / 64) AS rate FROM p)"


@query("p25_rotary_vector", f"WITH {_COMPONENTS} SELECT vec_id, CAST(i AS INTEGER) AS i, {z6_sql('CASE WHEN i % 2 = 0 THEN v[i + 1] * cos(vec_id * rate) - v[i + 2] * sin(vec_id * rate) ELSE v[i] * sin(vec_id * rate) + v[i + 1] * cos(vec_id * rate) END', 'value')} FROM t")
def p25r(spark, sf):
    turned = fn.rotary_vector(F.col("v"), F.col("vec_id"), 64)
    return q.vectors(spark, sf).select("vec_id", F.posexplode(turned).alias("i", "c")).select("vec_id", "i", z6(F.col("c"), "value"))


@query("p25_sinusoidal", f"WITH {_COMPONENTS} SELECT vec_id, CAST(i AS INTEGER) AS i, {z6_sql('v[i + 1] + CASE WHEN i % 2 = 0 THEN sin(vec_id % 32 * rate) ELSE cos(vec_id % 32 * rate) END', 'value')} FROM t")
def p25s(spark, sf):
    placed = F.zip_with("v", fn.sinusoidal(F.col("vec_id") % 32, 64), lambda a, b: a + b)
    return q.vectors(spark, sf).select("vec_id", F.posexplode(placed).alias("i", "c")).select("vec_id", "i", z6(F.col("c"), "value"))


def _determinant(m: list[list[str]]) -> str:
    """Sum over permutations."""
    def sign(p):
        return "-" if sum(a > b for i, a in enumerate(p) for b in p[i + 1:]) % 2 else "+"

    return "(" + " ".join(f"{sign(p)} " + " * ".join(m[i][c] for i, c in enumerate(p)) for p in permutations(range(len(m)))) + ")"


def _inverse_sql() -> str:
    m = [[f"m[{4 * i + j + 1}]" for j in range(4)] for i in range(4)]
    without = lambda r, c: [[x for j, x in enumerate(row) if j != c] for i, row in enumerate(m) if i != r]
    entries = ", ".join(f"{'-' if (i + j) % 2 else ''}{_determinant(without(j, i))} / {_determinant(m)}" for i in range(4) for j in range(4))
    return f"""WITH {q._VEC}, b AS (SELECT vec_id, v, unnest(range(4)) AS block FROM e),
k AS (SELECT vec_id, block, [v[16 * block + j + 1] + CASE WHEN j % 5 = 0 THEN 2.0 ELSE 0.0 END FOR j IN range(16)] AS m FROM b),
w AS (SELECT vec_id, block, unnest([{entries}]) AS c, unnest(range(16)) AS i FROM k)
SELECT vec_id, CAST(block AS INTEGER) AS block, CAST(i AS INTEGER) AS i, {z6_sql('c', 'value')} FROM w"""


@query("p19_matrix_inverse", _inverse_sql())
def p19m(spark, sf):
    blocks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.transform(F.slice("v", b * 16 + 1, 16), lambda x, j: x + F.when(j % 5 == 0, 2.0).otherwise(0.0)))
    each = q.vectors(spark, sf).select("vec_id", F.posexplode(blocks).alias("block", "m"))
    inverse = geo.invert_matrix([F.get("m", F.lit(i)) for i in range(16)])
    return each.select("vec_id", "block", F.posexplode(inverse).alias("i", "c")).select("vec_id", "block", "i", z6(F.col("c"), "value"))


# Features


@query("a33_layer_distance", f"""WITH {q._VEC}, l AS (SELECT label, unnest(range(4)) AS layer, v FROM e),
s AS (SELECT label, layer, v[16 * layer + 1 : 16 * layer + 16] AS a, v[16 * ((layer + 1) % 4) + 1 : 16 * ((layer + 1) % 4) + 16] AS b FROM l),
d AS (SELECT label, layer, 1 - avg(list_inner_product(a, b) / ((sqrt(list_inner_product(a, a)) + 1e-10) * (sqrt(list_inner_product(b, b)) + 1e-10))) AS d FROM s GROUP BY 1, 2)
SELECT label, round(sum(d), 6) AS distance FROM d GROUP BY 1""")
def a33l(spark, sf):
    layers = q.vectors(spark, sf).withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(3))))
    places = layers.withColumn("a", F.slice("v", F.col("layer") * 16 + 1, 16)).withColumn("b", F.slice("v", (F.col("layer") + 1) % 4 * 16 + 1, 16))
    return ft.layer_distance(places, ["label"], "layer", "a", "b").select("label", r6("distance", "distance"))


@query("a40_view_weighted", f"""WITH {q._VEC}, p AS (SELECT vec_id, label, 1 / (1 + exp(-v[1])) AS weight, unnest(v[1:32]) AS a, unnest(v[33:64]) AS b, unnest(range(32)) AS i FROM e),
c AS (SELECT vec_id, label, weight, i // 8 AS g, avg(a * b) AS c FROM p GROUP BY 1, 2, 3, 4) SELECT label, CAST(g AS INTEGER) AS g, {z6_sql('sum(c * weight) / sum(weight)', 'c')} FROM c GROUP BY label, c.g""")
def a40v(spark, sf):
    alike = ft.group_correlation(F.slice("v", 1, 32), F.slice("v", 33, 32), 4, 32)
    views = q.vectors(spark, sf).select("label", fn.sigmoid(F.get("v", F.lit(0))).alias("weight"), F.posexplode(alike).alias("g", "c"))
    return ft.view_weighted(views, ["label", "g"], "c", "weight").select("label", "g", z6(F.col("c"), "c"))


@query("a44_running_moments", f"""WITH RECURSIVE {q._VEC}, p AS (SELECT vec_id // 64 AS batch, unnest(v) AS c, unnest(range(64)) AS i FROM e),
b AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY batch) AS n, avg(c) AS m, var_samp(c) AS s FROM p GROUP BY i, batch),
r AS (SELECT i, 0::BIGINT AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS variance FROM range(64) t(i) UNION ALL SELECT b.i, b.n, 0.9 * r.mean + 0.1 * b.m, 0.9 * r.variance + 0.1 * b.s FROM r JOIN b ON b.i = r.i AND b.n = r.n + 1)
SELECT CAST(i AS INTEGER) AS i, {z6_sql('arg_max(mean, n)', 'mean')}, {z6_sql('arg_max(variance, n)', 'variance')} FROM r GROUP BY i""")
def a44r(spark, sf):
    rows = q.vectors(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 64))
    return ft.running_moments(rows, "batch", "v").select("i", z6(F.col("mean"), "mean"), z6(F.col("variance"), "variance"))


# Similarity of images


@query("a32_masked_ssim", q._ssim_sql(masked=True))
def a32m(spark, sf):
    grid = q.dense_pixels(spark, sf).withColumn("mask", F.when(F.col("hole"), 0.0).otherwise(1.0))
    return ev.ssim(grid, "g", "b", mask="mask").select("video", "frame", r6("ssim", "ssim"))


def _both_eyes(spark, sf):
    right = fr.with_holes(q.right_view(spark, sf), H, W, ("r", "g", "b")).fillna(0.0, ["r", "g", "b"])
    return q.dense_pixels(spark, sf), right


_EYES = f"{q._NORM}, {q._RIGHT}, {DENSE}, rd AS (SELECT g.video, g.frame, g.y, g.x, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b FROM grid g LEFT JOIN rp p USING (video, frame, y, x))"


def _box_ssim_sql() -> str:
    names = [f"{n}{c}" for c in "rgb" for n in ("x", "y", "xx", "yy", "xy")]
    box = ", ".join(f"avg({n}) OVER w AS {n}" for n in names)
    products = ", ".join(f"d.{c} AS x{c}, e.{c} AS y{c}, d.{c} * d.{c} AS xx{c}, e.{c} * e.{c} AS yy{c}, d.{c} * e.{c} AS xy{c}" for c in "rgb")
    grown = "49.0::DOUBLE / 48.0::DOUBLE"
    alike = " + ".join(f"(2 * x{c} * y{c} + 1e-4) * (2 * (xy{c} - x{c} * y{c}) * {grown} + 9e-4) / ((x{c} * x{c} + y{c} * y{c} + 1e-4) * ((xx{c} - x{c} * x{c} + yy{c} - y{c} * y{c}) * {grown} + 9e-4))" for c in "rgb")
    rows = "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"
    return f"""WITH {_EYES}, s AS (SELECT d.video, d.frame, d.y, d.x, {products} FROM dense d JOIN rd e USING (video, frame, y, x)),
a AS (SELECT video, frame, y, x, {box} FROM s WINDOW w AS (PARTITION BY video, frame, y ORDER BY x {rows})),
c AS (SELECT video, frame, y, x, {box} FROM a WINDOW w AS (PARTITION BY video, frame, x ORDER BY y {rows})),
f AS (SELECT video, frame, avg(({alike}) / 3) AS ssim FROM c WHERE y BETWEEN 3 AND {H - 4} AND x BETWEEN 3 AND {W - 4} GROUP BY 1, 2)
SELECT video, round(avg(ssim), 6) AS ssim_all, round(avg(ssim) FILTER (frame % 3 <> 1), 6) AS ssim_rest FROM f GROUP BY 1"""


@query("a31_split_ssim", _box_ssim_sql())
def a31s(spark, sf):
    left, right = _both_eyes(spark, sf)
    both = left.select(*PIXEL, "r", "g", "b").join(right.select(*PIXEL, *[F.col(c).alias(f"{c}2") for c in "rgb"]), PIXEL)
    each = ev.box_ssim(both, [(c, f"{c}2") for c in "rgb"], H, W)
    return ls.split_means(each, ("ssim",), F.col("frame") % 3 == 1, ("video",)).select("video", *r6s("ssim_all", "ssim_rest"))


_AT = lambda c, n: f"greatest(({c} + 0.5) * {n - 5} / {n} - 0.5, 0)"


@query("p37_trim_both", f"""WITH {_EYES}, eyes AS (SELECT 'left' AS eye, video, frame, y, x, r, g, b FROM dense UNION ALL SELECT 'right', video, frame, y, x, r, g, b FROM rd),
t AS (SELECT eye, video, frame, y, x, {_AT('y', H)} AS fy, {_AT('x', W)} AS fx FROM eyes),
k AS (SELECT *, CAST(floor(fy) AS INTEGER) AS y0, least(CAST(floor(fy) AS INTEGER) + 1, {H - 6}) AS y1, CAST(floor(fx) AS INTEGER) AS x0, least(CAST(floor(fx) AS INTEGER) + 1, {W - 6}) AS x1, fy - floor(fy) AS wy, fx - floor(fx) AS wx FROM t)
SELECT k.eye, k.video, k.frame, k.y, k.x, """ + ", ".join(nudged_sql(f"((p.{c} * (1 - wx) + s.{c} * wx) * (1 - wy) + (u.{c} * (1 - wx) + z.{c} * wx) * wy)", c) for c in "rgb") + """ FROM k
JOIN eyes p ON p.eye = k.eye AND p.video = k.video AND p.frame = k.frame AND p.y = y0 AND p.x = x0 JOIN eyes s ON s.eye = k.eye AND s.video = k.video AND s.frame = k.frame AND s.y = y0 AND s.x = x1
JOIN eyes u ON u.eye = k.eye AND u.video = k.video AND u.frame = k.frame AND u.y = y1 AND u.x = x0 JOIN eyes z ON z.eye = k.eye AND z.video = k.video AND z.frame = k.frame AND z.y = y1 AND z.x = x1""")
def p37t(spark, sf):
    left, right = _both_eyes(spark, sf)
    return im.trimmed_pair(left, right, 5, H, W).select("eye", *PIXEL, *[nudged(c, c) for c in "rgb"])


# Time and manifests


@query("a46_nested_stages", """WITH s AS (SELECT event_type || '/' || (user_id % 4) AS stage, event_type AS parent, value AS seconds FROM events UNION ALL SELECT event_type, NULL, value FROM events),
t AS (SELECT stage, parent, sum(seconds) AS seconds FROM s GROUP BY 1, 2)
SELECT t.stage, t.parent, round(t.seconds, 4) AS seconds, round(t.seconds / coalesce(o.seconds, (SELECT sum(value) FROM events)), 6) AS share, round(1000 / t.seconds, 6) AS fps FROM t LEFT JOIN t o ON o.stage = t.parent""")
def a46n(spark, sf):
    events = v.table(spark, sf, "events").select("event_type", "user_id", F.col("value").alias("seconds"))
    inner = events.select(F.concat_ws("/", "event_type", F.col("user_id") % 4).alias("stage"), F.col("event_type").alias("parent"), "seconds")
    rows = inner.unionByName(events.select(F.col("event_type").alias("stage"), F.lit(None).cast("string").alias("parent"), "seconds"))
    return tp.nested_stage_report(rows, 1000).select("stage", "parent", F.round("seconds", 4).alias("seconds"), *r6s("share", "fps"))


@query("w08_recurrent_pool", f"""WITH RECURSIVE {FR}, tap AS (SELECT f.video, f.idx, f.value, sum(g.value * t.n) AS five FROM fr f JOIN (SELECT video, max(idx) AS z FROM fr GROUP BY 1) m USING (video), (SELECT unnest([-5, -1, 0, 1, 5]) AS d, 1 AS n) t JOIN fr g ON g.video = f.video AND g.idx = least(greatest(f.idx + t.d, 0), m.z) GROUP BY 1, 2, 3),
o AS (SELECT video, idx, (five + value) / 6 AS out FROM tap WHERE idx = 0 UNION ALL SELECT t.video, t.idx, (t.five + o.out) / 6 FROM o JOIN tap t ON t.video = o.video AND t.idx = o.idx + 1)
SELECT video, idx, {nudged_sql('out', 'out')} FROM o""")
def w08r(spark, sf):
    out = tp.recurrent_pool(v.frame_stream(spark, sf), lambda pool: float(np.mean(pool)))
    return out.select("video", F.col("idx").cast("int").alias("idx"), nudged("out", "out"))


@query("k07_manifest_cameras", f"WITH {MAN} SELECT dataset, scene, frame, image, factor * 2 AS fx, factor AS cx, factor + frame AS tx FROM man")
def k07(spark, sf):
    row = lambda *c: F.array(*[F.lit(x).cast("double") if isinstance(x, (int, float)) else x.cast("double") for x in c])
    factor = F.col("factor")
    cameras = F.array(row(factor * 2, 0, factor), row(0, factor * 2, factor), row(0, 0, 1))
    poses = F.array(row(1, 0, 0, factor + F.col("frame")), row(0, 1, 0, 0), row(0, 0, 1, 0), row(0, 0, 0, 1))
    documents = mf.build_manifest(v.manifest_rows(spark, sf).withColumn("K", cameras).withColumn("pose", poses))
    return mf.flatten_manifest(documents).select("dataset", "scene", "frame", "image", F.col("K")[0][0].alias("fx"), F.col("K")[1][2].alias("cx"), F.col("pose")[0][3].alias("tx"))
