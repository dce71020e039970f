"""Queries of places between pixels, multi-view samples and metric alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import images as im
from framelake.operators import patchmatch as pm
from framelake.operators import samples as sa
from framelake.operators import temporal as tp
from framelake.plans import queries as q
from framelake.plans import views as v
from framelake.plans.further_queries import z6, z6_sql
from framelake.plans.registry import PIXEL, nudged, nudged_sql, query, r6
from framelake.plans.views import DENSE, FR, MAN, PX, H, W

# Offsets of each pixel's own: a ring two pixels away, bent by waves.

_RING = im.propagation_offsets(8, 2)


def _bent(spark, sf):
    ring = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(_RING)])
    each = q.dense_pixels(spark, sf).select(*PIXEL, F.explode(ring).alias("o"))
    dy, dx = F.col("o.dy") + F.sin(F.col("x") + F.col("o.k")) * 0.3, F.col("o.dx") + F.cos(F.col("y") + F.col("o.k")) * 0.3
    return each.select(*PIXEL, "o.k", dy.alias("dy"), dx.alias("dx"))


def _depths(spark, sf):
    return q.dense_pixels(spark, sf).select(*PIXEL, (F.col("depth") / v.DEPTH_SCALE + 1).alias("depth"))


def _sampled_sql(value: str) -> str:
    """The values at all bent places, each corner joined for itself."""
    ring = ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(_RING))
    corner = lambda i, j: f"JOIN d q{i}{j} ON q{i}{j}.video = pl.video AND q{i}{j}.frame = pl.frame AND q{i}{j}.y = least(floor(v) + {i}, {H - 1}) AND q{i}{j}.x = least(floor(u) + {j}, {W - 1})"
    return f"""{PX}, {DENSE}, d AS (SELECT video, frame, y, x, {value} AS z FROM dense), ring AS (SELECT * FROM (VALUES {ring}) AS t(k, ry, rx)),
pl AS (SELECT d.*, k, least(greatest((y + ry + 0.3::DOUBLE * sin(x + k)) * {H} / {H - 1} - 0.5, 0), {H - 1}) AS v, least(greatest((x + rx + 0.3::DOUBLE * cos(y + k)) * {W} / {W - 1} - 0.5, 0), {W - 1}) AS u FROM d, ring),
s AS (SELECT pl.video, pl.frame, pl.y, pl.x, pl.z, k, (q00.z * (1 - (u - floor(u))) + q01.z * (u - floor(u))) * (1 - (v - floor(v))) + (q10.z * (1 - (u - floor(u))) + q11.z * (u - floor(u))) * (v - floor(v)) AS sampled
  FROM pl {' '.join(corner(i, j) for i in (0, 1) for j in (0, 1))})"""


_DEPTH = f"depth / {v.DEPTH_SCALE}::DOUBLE + 1"


@query("w14_bent_propagation", f"""WITH {_sampled_sql(_DEPTH)},
a AS (SELECT video, frame, y, x, k, sampled FROM s UNION ALL SELECT video, frame, y, x, -1, z - 0.5::DOUBLE FROM d UNION ALL SELECT video, frame, y, x, -2, z FROM d UNION ALL SELECT video, frame, y, x, -3, z + 0.25::DOUBLE FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY video, frame, y, x ORDER BY sampled) AS r FROM a)
SELECT video, frame, y, x, CAST(count(*) AS INTEGER) AS n, {nudged_sql('max(sampled) FILTER (r = 1)', 'least')}, {nudged_sql('max(sampled) FILTER (r = 6)', 'middle')}, {nudged_sql('max(sampled) FILTER (r = 11)', 'most')} FROM r GROUP BY 1, 2, 3, 4""")
def w14_bent(spark, sf):
    given = _depths(spark, sf).select(*PIXEL, F.array(F.col("depth") - 0.5, F.col("depth"), F.col("depth") + 0.25).alias("depths"))
    found = pm.propagated(given, _bent(spark, sf), H, W)
    at = lambda i, name: nudged(F.get("depths", F.lit(i)), name)
    return found.select(*PIXEL, F.size("depths").alias("n"), at(0, "least"), at(5, "middle"), at(10, "most"))


_SHARE = f"(1 / ({_DEPTH}) - 1 / 8.0::DOUBLE) / (1 / 0.5::DOUBLE - 1 / 8.0::DOUBLE)"


@query("p29_neighbour_weights", f"WITH {_sampled_sql(_SHARE)} SELECT video, frame, y, x, round(sum(1 / (1 + exp(-2 * (2 - least(abs(sampled - z) / 0.025::DOUBLE, 4))))), 6) AS weight FROM s GROUP BY 1, 2, 3, 4")
def p29_near(spark, sf):
    found = pm.neighbour_weights(_depths(spark, sf), _bent(spark, sf), H, W, 0.5, 8.0, 0.025)
    return found.groupBy(*PIXEL).agg(F.sum("weight").alias("weight")).select(*PIXEL, r6("weight", "weight"))


# Samples of views

_REUSE = 0.5
_DRAW = "CAST(('0x' || substr(md5(concat_ws(':', 'views reuse', k.dataset, k.scene, CAST(k.slot - 1 AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query("s15_view_samples", f"""WITH {MAN}, p AS (SELECT dataset, scene, frame AS place, row_number() OVER (PARTITION BY dataset, scene ORDER BY md5(concat_ws(':', 'views', dataset, scene, CAST(frame AS VARCHAR))), frame) - 1 AS slot FROM man),
k AS (SELECT * FROM p WHERE slot < 3),
r AS (SELECT k.dataset, k.scene, k.slot, CASE WHEN k.slot = 1 AND {_DRAW} <= {_REUSE} THEN f.place ELSE k.place END AS place FROM k JOIN k f ON f.dataset = k.dataset AND f.scene = k.scene AND f.slot = 0),
m AS (SELECT dataset, scene, avg(50.0::DOUBLE + place) AS fx, avg(30.0::DOUBLE + place) AS cx FROM r GROUP BY 1, 2)
SELECT r.dataset, r.scene, CAST(slot AS INTEGER) AS slot, CAST(place AS INTEGER) AS place, round(cos(0.1::DOUBLE * place), 6) AS r00, round(place / 200.0::DOUBLE, 6) AS t0,
  {z6_sql('-(cos(0.1::DOUBLE * place) * place + sin(0.1::DOUBLE * place) * 2) / 200', 'back0')}, round(fx * 0.5, 6) AS fx, round(-cx / fx, 6) AS far_cx
FROM r JOIN m ON m.dataset = r.dataset AND m.scene = r.scene""")
def s15(spark, sf):
    """Views of each scene, its first one for input and again as a target in half of the scenes; cameras turned about z by a tenth for each place."""
    keys = ["dataset", "scene"]
    views = sa.drawn_views(v.manifest_rows(spark, sf).select(*keys, F.col("frame").alias("place")), keys, 3, 1, _REUSE)
    place, zero, one = F.col("place").cast("double"), F.lit(0.0), F.lit(1.0)
    a = place * 0.1
    # Scenes share the rig, a row for each place.
    cameras = v.manifest_rows(spark, sf).select(F.col("frame").alias("place")).distinct().select(
        "place",
        F.array(F.cos(a), -F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, one).alias("rotation"),
        F.array(place, F.lit(2.0), F.lit(3.0)).alias("translation"),
        F.array(place + 50, zero, place + 30, zero, place + 60, F.lit(20.0), zero, zero, one).alias("intrinsics"),
    )
    out = sa.with_cameras(views, cameras, keys, ["place"], scale=200.0, resized=0.5, invert_resized=False)
    at = lambda c, i, name: r6(F.get(c, F.lit(i)), name)
    return out.select(*keys, "slot", "place", at("pose", 0, "r00"), at("pose", 3, "t0"), z6(F.get("pose_inverse", F.lit(3)), "back0"), at("k", 0, "fx"), at("k_inverse", 2, "far_cx"))


@query("s16_mask_boxes", f"WITH {PX} SELECT video, frame, min(x) / 2.0::DOUBLE AS x0, min(y) / 2.0::DOUBLE AS y0, max(x) / 2.0::DOUBLE AS x1, max(y) / 2.0::DOUBLE AS y1 FROM px WHERE r > 10 GROUP BY 1, 2")
def s16(spark, sf):
    boxes = sa.mask_boxes(v.pixels(spark, sf), ["video", "frame"], F.col("r") > 10, 0.5)
    return boxes.select("video", "frame", *[F.get("box", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


# Alignment

@query("w05_metric_alignment", f"""WITH {FR}, {q._LEN}, g AS (SELECT video, n, unnest(range(CAST(ceil(n / 22.0) AS BIGINT))) AS k FROM ln), j AS (SELECT *, unnest(range(32)) AS slot FROM g),
sl AS (SELECT video, k, slot, CASE WHEN k > 0 AND slot = 0 THEN 0 WHEN k > 0 AND slot = 1 THEN 22 * k - 10 ELSE least(22 * k + slot, n - 1) END AS idx FROM j),
al AS (SELECT sl.video, k, slot, 22 * k + slot AS idx, CASE WHEN k = 0 THEN value + k - 60 ELSE greatest(value + k - 60, 0) END AS v FROM sl JOIN fr ON fr.video = sl.video AND fr.idx = sl.idx),
faded AS (SELECT n.video, n.idx, o.v * (1 - (n.slot - 2) / 7.0::DOUBLE) + n.v * ((n.slot - 2) / 7.0::DOUBLE) AS v FROM al n JOIN al o ON o.video = n.video AND o.k = n.k - 1 AND o.idx = n.idx WHERE n.slot BETWEEN 2 AND 9),
whole AS (SELECT al.video, al.idx, coalesce(f.v, al.v) AS v FROM al LEFT JOIN faded f ON f.video = al.video AND f.idx = al.idx WHERE al.k = 0 OR al.slot > 9)
SELECT video, CAST(idx AS BIGINT) AS frame, round(v, 6) AS value FROM whole JOIN ln USING (video) WHERE idx < n""")
def w05_metric(spark, sf):
    values = v.frame_stream(spark, sf).select("video", F.col("idx").alias("frame"), "value")
    given = tp.windows(q.lengths(spark, sf)).join(values, ["video", "frame"]).withColumn("value", F.col("value") + F.col("window") - 60)
    return tp.align_windows(given, metric=True).select("video", "frame", r6("value", "value"))
