"""Queries over the views, one per operator, each with the same in DuckDB's SQL where SQL can say it.

Derived doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake import functions as fn
from framelake.operators import evaluation as ev
from framelake.operators import features as ft
from framelake.operators import frames as fr
from framelake.operators import geometry as geo
from framelake.operators import poses as posed
from framelake.operators import resize as rs
from framelake.operators import temporal as tp
from framelake.plans import views as v
from framelake.plans.registry import FOCAL, MAX_DISPARITY, MOVE, ORACLES, PIXEL, QUERIES, nudged, nudged_sql, query, r6, r6s
from framelake.plans.streams import stream_folder
from framelake.plans.views import DENSE, FR, GRID, H, MAN, PG, PX, W
from framelake.sources import manifest as mf
from framelake.sources.listing import split_list, view_table, with_names

__all__ = ["ORACLES", "QUERIES"]

_NORM = f"""{PX}, q AS (SELECT video, frame, quantile_cont(depth, 0.01) AS lo, quantile_cont(depth, 0.99) AS hi FROM px GROUP BY 1, 2),
nm AS (SELECT px.*, least(greatest((depth - lo) / greatest(hi - lo, 1e-6), 0.0), 1.0) AS near FROM px JOIN q USING (video, frame)),
dp AS (SELECT *, near * {MAX_DISPARITY} AS disparity FROM nm),
mv AS (SELECT *, CAST(round_even(x - disparity, 0) AS INTEGER) AS xt, CAST(y * {W} + x AS BIGINT) AS src FROM dp WHERE CAST(round_even(x - disparity, 0) AS INTEGER) BETWEEN 0 AND {W - 1})"""


def disparity_pixels(spark, sf) -> DataFrame:
    return fr.near_and_disparity(fr.quantile_normalise(v.pixels(spark, sf)), "inverse", MAX_DISPARITY)


def dense_pixels(spark, sf) -> DataFrame:
    grid = fr.with_holes(v.pixels(spark, sf), H, W, ("depth", "r", "g", "b"))
    return grid.fillna(0.0, ["depth", "r", "g", "b"])


# Listings and manifests


@query("s01_file_listing", r"SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\.[^.]*)$', 1)) AS suffix FROM pages")
def s01(spark, sf):
    return with_names(v.table(spark, sf, "pages").select("page_id", "url"), "url").orderBy("url")


@query("p30_swap_suffix", f"WITH {MAN} SELECT image, regexp_replace(image, '\\.(jpg|png)$', '.npy') AS swapped, CAST(right(regexp_replace(image, '\\.[^.]*$', ''), 4) AS INTEGER) AS digits FROM man")
def p30(spark, sf):
    return v.manifest_rows(spark, sf).select("image", fn.swap_suffix(F.col("image")).alias("swapped"), fn.last_digits_key(F.col("image")).alias("digits"))


_NATURAL = "array_to_string(list_transform(regexp_extract_all(path, '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN lpad(t, 20, '0') ELSE t END), chr(1))"


@query("o02_natural_sort", f"SELECT path, host, CAST(row_number() OVER (PARTITION BY host ORDER BY {_NATURAL}, path) AS INTEGER) AS place FROM (SELECT url || '/scene' || lpad(CAST(page_id % 10 AS VARCHAR), 4, '0') || '_00/color/' || (page_id * 7919 % 1009) || '.jpg' AS path, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages)")
def o02(spark, sf):
    from pyspark.sql import Window

    scene = F.concat(F.lit("/scene"), F.lpad((F.col("page_id") % 10).cast("string"), 4, "0"), F.lit("_00/color/"), (F.col("page_id") * 7919 % 1009).cast("string"), F.lit(".jpg"))
    paths = v.table(spark, sf, "pages").select(F.concat("url", scene).alias("path"), F.regexp_extract("url", "://([^/]*)", 1).alias("host"))
    return paths.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(fn.natural_key(F.col("path")))))


@query("s05_stride_decord", f"WITH {FR}, s AS (SELECT *, CAST(greatest(round_even((CASE WHEN video % 4 > 0 THEN video % 4 * 12.0 ELSE 30.0 END) / 12.0, 0), 1) AS INTEGER) AS stride FROM fr) SELECT video, idx, stride FROM s WHERE idx % stride = 0 AND idx / CAST(stride AS DOUBLE) < 6")
def s05d(spark, sf):
    return tp.sampled(v.frame_stream(spark, sf), (F.col("video") % 4 * 12).cast("double"), 12.0, 6, "decord").select("video", "idx", "stride")


@query("s05_stride_cv2", f"WITH {FR}, s AS (SELECT *, CAST(greatest(round_even((CASE WHEN video % 4 > 0 THEN video % 4 * 12.0 ELSE 30.0 END) / 12.0, 0), 1) AS INTEGER) AS stride FROM fr) SELECT video, idx, stride FROM s WHERE idx % stride = 0 AND idx < 6")
def s05c(spark, sf):
    return tp.sampled(v.frame_stream(spark, sf), (F.col("video") % 4 * 12).cast("double"), 12.0, 6, "cv2").select("video", "idx", "stride")


@query("s13_manifest_flatten", f"WITH {MAN} SELECT dataset, scene, frame, image, gt_depth, factor FROM man")
def s13(spark, sf):
    return mf.flatten_manifest(mf.build_manifest(v.manifest_rows(spark, sf))).select("dataset", "scene", "frame", "image", "gt_depth", "factor")


@query("s17_split_list", "SELECT DISTINCT source, lang FROM documents WHERE source <> '' AND lang IS NOT NULL")
def s17(spark, sf):
    """List files, a folder for each source and in it a line for each language, read again."""
    folder = f"{stream_folder(spark)}/{uuid.uuid4()}"
    lines = v.table(spark, sf, "documents").select("source", F.concat(F.lit(" "), "lang").alias("value")).filter("source <> '' AND lang IS NOT NULL").distinct()
    lines.repartition("source").write.partitionBy("source").text(folder)
    return split_list(spark, [f"{folder}/source=*"]).select(F.regexp_extract("folder", "source=(.*)$", 1).alias("source"), F.col("line").alias("lang"))


@query("j01_positional_zip", "WITH a AS (SELECT s_nationkey AS nation, s_name AS image, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS place FROM supplier), b AS (SELECT c_nationkey AS nation, c_name AS depth, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS place FROM customer) SELECT nation, CAST(place AS INTEGER) AS place, image, depth FROM a JOIN b USING (nation, place)")
def j01(spark, sf):
    a = v.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("image"))
    b = v.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("depth"))
    return mf.positional_zip(a, b, ["nation"], F.col("image"), F.col("depth"))


@query("f07_existing_files", f"WITH {MAN} SELECT dataset, scene, image FROM man WHERE image IN (SELECT s_name || '.jpg' FROM supplier WHERE s_acctbal > 0)")
def f07(spark, sf):
    files = v.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat("s_name", F.lit(".jpg")).alias("image"))
    return mf.existing(v.manifest_rows(spark, sf), files, "image").select("dataset", "scene", "image")


@query("u03_view_difference", f"WITH {MAN} SELECT scene, frame FROM man WHERE (scene, frame) NOT IN (SELECT scene, frame FROM man WHERE frame % 3 = 1)")
def u03(spark, sf):
    rows = v.manifest_rows(spark, sf)
    return mf.without(rows, rows.filter("frame % 3 = 1"), ["scene", "frame"]).select("scene", "frame")


@query("j10_view_table", "SELECT CAST(l_linenumber AS VARCHAR) AS category, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS object, CAST(count(*) AS INTEGER) AS views, CAST(min(l_suppkey % 100) AS INTEGER) AS first, CAST(sum(l_suppkey % 100) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2")
def j10(spark, sf):
    views = F.array_join(F.transform(F.sort_array(F.collect_list(F.col("l_suppkey") % 100)), lambda x: x.cast("string")), " ")
    lines = v.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("c"), F.col("l_quantity").cast("int").alias("o")).agg(views.alias("views"))
    each = view_table(lines.select(F.concat_ws(" ", F.col("c").cast("string"), F.col("o").cast("string"), "views").alias("value")))
    return each.select("category", "object", F.size("views").alias("views"), F.col("views")[0].alias("first"), F.aggregate("views", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"))


@query("p41_nested_map", "SELECT o_orderkey, 2.0::DOUBLE * o_totalprice AS price, 2.0::DOUBLE * (o_orderkey % 7) AS rest, 2.0::DOUBLE * o_custkey AS customer FROM orders")
def p41(spark, sf):
    rows = v.table(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("p"), F.array(F.col("o_orderkey") % 7).alias("a"), F.create_map(F.lit("k"), F.struct(F.col("o_custkey").alias("c"))).alias("m")).alias("n"))
    doubled = rows.select("o_orderkey", fn.nested_map(F.col("n"), rows.schema["n"].dataType, lambda c: c.cast("double") * 2).alias("n"))
    return doubled.select("o_orderkey", F.col("n.p").alias("price"), F.col("n.a")[0].alias("rest"), F.col("n.m")["k"]["c"].alias("customer"))


# Pixels


@query("p04_disparity", f"WITH {_NORM} SELECT video, frame, y, x, round(near, 6) AS near, round(disparity, 6) AS disparity FROM dp")
def p04(spark, sf):
    return disparity_pixels(spark, sf).select(*PIXEL, *r6s("near", "disparity"))


@query("p03_balanced", f"WITH {PX} SELECT video, frame, y, x, round((g - 0.5) / 0.5, 6) AS signed, round(ceil(g * 255) / 255.0, 6) AS quantised, round((g - 0.456) / 0.224, 6) AS standard FROM px")
def p03(spark, sf):
    return v.pixels(spark, sf).select(*PIXEL, r6(fn.balanced(F.col("g")), "signed"), r6(fn.quantise_up(F.col("g")), "quantised"), r6(fn.standardise(F.col("g"), *fn.CHANNEL_STATISTICS["g"]), "standard"))


_MINMAX = f"{PX}, mm AS (SELECT px.*, CASE WHEN hi = lo THEN 0.0 ELSE (depth - lo) / (hi - lo) END AS norm FROM px JOIN (SELECT video, frame, min(depth) AS lo, max(depth) AS hi FROM px GROUP BY 1, 2) USING (video, frame))"


@query("p08_quantise_u8", f"WITH {_MINMAX} SELECT video, frame, y, x, CAST(floor(norm * 255) AS INTEGER) AS level FROM mm")
def p08(spark, sf):
    return fr.minmax_normalise(v.pixels(spark, sf)).select(*PIXEL, fn.quantise(F.col("norm")).alias("level"))


@query("p09_bit_depth", f"WITH {_MINMAX} SELECT video, frame, y, x, CAST(floor(65535.0 - norm * 65535.0) AS INTEGER) AS level FROM mm")
def p09(spark, sf):
    return fr.bit_depth(v.pixels(spark, sf), 16).select(*PIXEL, "level")


@query("p10_crop", f"WITH {PX} SELECT video, frame, y, x, depth FROM px WHERE y >= 4 AND y < {H} - 4 AND x >= 5 AND x < 60")
def p10(spark, sf):
    return fr.crop(v.pixels(spark, sf), 4, -4, 5, 60, H, W).select(*PIXEL, "depth")


@query("p06_inverse_depth", f"WITH {PX} SELECT video, frame, y, x, round(CASE WHEN depth - 5000 > 0 THEN 1 / (depth - 5000) ELSE 0 END, 6) AS inverse, round(least(greatest(1000.0 / depth, 0.01), 1000.0) / 1000.0, 6) AS norm FROM px")
def p06(spark, sf):
    return v.pixels(spark, sf).select(*PIXEL, r6(fr.depth_to_inverse(F.col("depth") - 5000), "inverse"), r6(fr.depth_norm(F.col("depth"), 0.01, 1000.0), "norm"))


_SIZES = "sz AS (SELECT p_partkey, p_size * 37 + 100 AS h, p_partkey % 50 * 41 + 120 AS w FROM part)"


def sizes(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 37 + 100).alias("h"), (F.col("p_partkey") % 50 * 41 + 120).alias("w"))


@query("p12_aspect_size", f"WITH {_SIZES} SELECT p_partkey, greatest(CAST(round_even(h * (518.0::DOUBLE / greatest(h, w)) / 14, 0) AS INTEGER) * 14, 14) AS nh, greatest(CAST(round_even(w * (518.0::DOUBLE / greatest(h, w)) / 14, 0) AS INTEGER) * 14, 14) AS nw FROM sz")
def p12(spark, sf):
    h, w = rs.aspect_size(F.col("h"), F.col("w"))
    return sizes(spark, sf).select("p_partkey", h.alias("nh"), w.alias("nw"))


@query("p11_sampled_size", f"WITH {_SIZES}, s AS (SELECT p_partkey, CAST(round_even(h * f, 0) AS INTEGER) AS h, CAST(round_even(w * f, 0) AS INTEGER) AS w FROM (SELECT *, CASE WHEN greatest(h, w) > 1000 THEN 1000.0::DOUBLE / greatest(h, w) ELSE 1.0 END AS f FROM sz)) SELECT p_partkey, h + h % 2 AS nh, w + w % 2 AS nw, h - h % 2 AS dh FROM s")
def p11(spark, sf):
    h, w = tp.sampled_size(F.col("h"), F.col("w"), 1000, "decord")
    plain, _ = tp.sampled_size(F.col("h"), F.col("w"), 1000, "cv2")
    return sizes(spark, sf).select("p_partkey", h.alias("nh"), w.alias("nw"), fn.even_down(plain).alias("dh"))


def _solver(name, scale, near):
    sql = f"WITH {_SIZES}, s AS (SELECT *, {scale} AS f FROM (SELECT *, 518.0::DOUBLE / h AS sh, 518.0::DOUBLE / w AS sw FROM sz)) SELECT p_partkey, {near('h')} AS nh, {near('w')} AS nw FROM s"
    method = name.removeprefix("p14_resize_")

    @query(name, sql)
    def run(spark, sf):
        h, w = rs.solved_size(F.col("h"), F.col("w"), 518, 518, method)
        return sizes(spark, sf).select("p_partkey", h.alias("nh"), w.alias("nw"))


_round = lambda c: f"CAST(round_even(f * {c} / 14, 0) AS INTEGER) * 14"
_solver("p14_resize_lower_bound", "greatest(sh, sw)", lambda c: f"CASE WHEN {_round(c)} < 518 THEN CAST(ceil(f * {c} / 14) AS INTEGER) * 14 ELSE {_round(c)} END")
_solver("p14_resize_upper_bound", "least(sh, sw)", lambda c: f"CASE WHEN {_round(c)} > 518 THEN CAST(floor(f * {c} / 14) AS INTEGER) * 14 ELSE {_round(c)} END")
_solver("p14_resize_minimal", "CASE WHEN abs(1 - sw) < abs(1 - sh) THEN sw ELSE sh END", _round)


@query("p15_shrunk_input", f"WITH {_SIZES} SELECT p_partkey, CAST(CASE WHEN greatest(h, w) / CAST(least(h, w) AS DOUBLE) > 1.78 THEN CAST(round_even(CAST(trunc(518 * 1.777::DOUBLE / (greatest(h, w) / CAST(least(h, w) AS DOUBLE))) AS INTEGER) / 14.0::DOUBLE, 0) AS INTEGER) * 14 ELSE 518 END AS INTEGER) AS size FROM sz")
def p15(spark, sf):
    return sizes(spark, sf).select("p_partkey", rs.shrunk_input_size(F.col("h"), F.col("w")).alias("size"))


_RIGHT = "rt AS (SELECT video, frame, y, xt AS x, max({'near': near, 'src': src, 'r': r, 'g': g, 'b': b}) AS m FROM mv GROUP BY 1, 2, 3, 4), rp AS (SELECT video, frame, y, x, m.r AS r, m.g AS g, m.b AS b FROM rt)"


def right_view(spark, sf):
    return fr.zbuffer_struct(disparity_pixels(spark, sf), W)


def _layout(layout, sql):
    @query(f"p16_layout_{layout}", f"WITH {_NORM}, {_RIGHT} {sql}")
    def run(spark, sf):
        out = fr.compose_stereo(v.pixels(spark, sf), right_view(spark, sf), layout, H, W, 0.3)
        return out.select(*PIXEL, *r6s("r", "g", "b"))


_RGB = "round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b"
_layout("sbs", f"SELECT video, frame, y, x, {_RGB} FROM px UNION ALL SELECT video, frame, y, x + {W}, {_RGB} FROM rp")
_layout("ou", f"SELECT video, frame, y, x, {_RGB} FROM px UNION ALL SELECT video, frame, y + {H}, x, {_RGB} FROM rp")
_layout("overlay", "SELECT video, frame, y, x, " + ", ".join(f"round(px.{c} * (1 - 0.3::DOUBLE) + rp.{c} * 0.3::DOUBLE, 6) AS {c}" for c in "rgb") + " FROM px JOIN rp USING (video, frame, y, x)")
_layout("anaglyph", "SELECT video, frame, y, x, round(px.r, 6) AS r, round(rp.g, 6) AS g, round(rp.b, 6) AS b FROM px JOIN rp USING (video, frame, y, x)")


@query("a01_quantile_norm", f"WITH {_NORM} SELECT video, frame, round(min(lo), 6) AS lo, round(min(hi), 6) AS hi, count(*) FILTER (near = 0) AS at_zero, count(*) FILTER (near = 1) AS at_one FROM nm JOIN q USING (video, frame) GROUP BY 1, 2")
def a01(spark, sf):
    px = v.pixels(spark, sf)
    stats = fr.quantile_normalise(px).groupBy("video", "frame").agg(F.count(F.when(F.col("norm") == 0, 1)).alias("at_zero"), F.count(F.when(F.col("norm") == 1, 1)).alias("at_one"))
    return fr.quantile_bounds(px).join(stats, ["video", "frame"]).select("video", "frame", *r6s("lo", "hi"), "at_zero", "at_one")


@query("a02_minmax_frame", f"WITH {_MINMAX} SELECT video, frame, y, x, round(norm, 6) AS norm FROM mm")
def a02(spark, sf):
    return fr.minmax_normalise(v.pixels(spark, sf)).select(*PIXEL, r6("norm", "norm"))


@query("a03_minmax_clip", f"WITH {PX} SELECT video, frame, y, x, round((depth - lo) / (hi - lo), 6) AS norm FROM px JOIN (SELECT video, min(depth) AS lo, max(depth) AS hi FROM px GROUP BY 1) USING (video)")
def a03(spark, sf):
    return fr.minmax_normalise(v.pixels(spark, sf), keys=("video",)).select(*PIXEL, r6("norm", "norm"))


@query("a04_zbuffer_struct", f"WITH {_NORM}, {_RIGHT} SELECT video, frame, y, x, m.src AS src, m.r AS r, m.g AS g, m.b AS b FROM rt")
def a04(spark, sf):
    return right_view(spark, sf).select(*PIXEL, "src", "r", "g", "b")


@query("a05_zbuffer_packed", f"WITH {_NORM}, pk AS (SELECT video, frame, y, xt AS x, max((CAST(floor(near * 1048575.0) AS BIGINT) << 20) | src) AS packed FROM mv GROUP BY 1, 2, 3, 4) SELECT pk.video, pk.frame, pk.y, pk.x, packed, packed & 1048575 AS src, m.r, m.g, m.b FROM pk JOIN mv m ON m.video = pk.video AND m.frame = pk.frame AND m.src = packed & 1048575")
def a05(spark, sf):
    return fr.zbuffer_packed(disparity_pixels(spark, sf), H, W).select(*PIXEL, "packed", "src", "r", "g", "b")


@query("a06_holes", f"WITH {_NORM}, {_RIGHT}, {GRID} SELECT video, frame, count(*) FILTER (rp.r IS NULL) AS holes, round(count(*) FILTER (rp.r IS NULL) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM grid LEFT JOIN rp USING (video, frame, y, x) GROUP BY 1, 2")
def a06(spark, sf):
    grid = fr.with_holes(right_view(spark, sf), H, W)
    hole = F.sum(F.col("hole").cast("long"))
    return grid.groupBy("video", "frame").agg(hole.alias("holes"), r6(hole / F.count("*"), "ratio"))


@query("a07_last_writer", f"WITH {_MINMAX}, m AS (SELECT *, x - CAST(trunc(norm * 12) AS INTEGER) AS xt FROM mm), b AS (SELECT video, frame, y, xt AS x, max({{'x': x, 'r': r, 'g': g, 'b': b}}) AS best FROM m WHERE xt >= 0 GROUP BY 1, 2, 3, 4) SELECT video, frame, y, x, best.x AS src_x, best.r AS r, best.g AS g, best.b AS b FROM b")
def a07(spark, sf):
    return fr.last_writer(fr.minmax_normalise(v.pixels(spark, sf)), 12)


@query("a09_painters", f"WITH {_NORM}, b AS (SELECT video, frame, y, xt AS x, max({{'near': -depth, 'src': src, 'r': r}}) AS best FROM mv GROUP BY 1, 2, 3, 4) SELECT video, frame, y, x, best.src AS src, best.r AS r FROM b")
def a09(spark, sf):
    return fr.painters(disparity_pixels(spark, sf).withColumn("z", F.col("depth")), W, ("r",)).select(*PIXEL, "src", "r")


def _inpaint_sql(after: str) -> str:
    half = 3
    sums = ", ".join(f"sum(CASE WHEN hole THEN 0.0 ELSE {c} END) OVER wx AS s{c}" for c in "rgb")
    sums2 = ", ".join(f"sum(s{c}) OVER wy AS s{c}" for c in "rgb")
    fill = ", ".join(f"CASE WHEN NOT hole THEN {c} WHEN n > 0 THEN s{c} / n ELSE 0.0 END AS {c}" for c in "rgb")
    return f"""WITH {PX}, {DENSE},
ax AS (SELECT *, sum(CASE WHEN hole THEN 0 ELSE 1 END) OVER wx AS n, {sums} FROM dense WINDOW wx AS (PARTITION BY video, frame, y ORDER BY x ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
ay AS (SELECT * REPLACE (sum(n) OVER wy AS n, {sums2}) FROM ax WINDOW wy AS (PARTITION BY video, frame, x ORDER BY y ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
fl AS (SELECT video, frame, y, x, {fill} FROM ay) {after}"""


@query("w10_dilate", f"WITH {PX}, {DENSE} SELECT video, frame, y, x, CASE WHEN x < {W} - 2 THEN max(CASE WHEN hole THEN 1 ELSE 0 END) OVER (PARTITION BY video, frame, y ORDER BY x ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1 ELSE hole END AS hole FROM dense")
def w10(spark, sf):
    return fr.dilate_left(fr.with_holes(v.pixels(spark, sf), H, W), 2, W).select(*PIXEL, "hole")


@query("w11_inpaint_compat", _inpaint_sql("SELECT video, frame, y, x, " + ", ".join(nudged_sql(c, c) for c in "rgb") + " FROM fl"))
def w11(spark, sf):
    return fr.box_inpaint(fr.with_holes(v.pixels(spark, sf), H, W), 7).select(*PIXEL, *[nudged(c, c) for c in "rgb"])


@query("w12_inpaint_sequential")
def w12(spark, sf):
    return fr.sequential_inpaint(fr.with_holes(v.pixels(spark, sf), H, W), H, W).select(*PIXEL, "r", "g", "b")


@query("a35_iou", f"WITH {PX} SELECT video, frame, round(count(*) FILTER (r > 25 AND g > 0.05) / CAST(count(*) FILTER (r > 25 OR g > 0.05) AS DOUBLE), 6) AS iou FROM px GROUP BY 1, 2")
def a35(spark, sf):
    return fr.mask_iou(v.pixels(spark, sf), F.col("r") > 25, F.col("g") > 0.05).select("video", "frame", r6("iou", "iou"))


@query("a36_bbox", f"WITH {PX} SELECT video, frame, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px WHERE r > 45 AND g > 0.05 AND b > 0.05 GROUP BY 1, 2")
def a36(spark, sf):
    return fr.bounding_box(v.pixels(spark, sf), (F.col("r") > 45) & (F.col("g") > 0.05) & (F.col("b") > 0.05))


# Geometry

_CAM = f"z AS (SELECT video, frame, y, x, depth / {v.DEPTH_SCALE} + 1 AS z FROM px), c AS (SELECT *, (x - {W / 2}) / {FOCAL} * z AS cx, (y - {H / 2}) / {FOCAL} * z AS cy FROM z)"


def z_pixels(spark, sf):
    return v.pixels(spark, sf).select(*PIXEL, (F.col("depth") / v.DEPTH_SCALE + 1).alias("z"))


@query("p20_unproject", f"WITH {PX}, {_CAM} SELECT video, frame, y, x, {nudged_sql('cx', 'px')}, {nudged_sql('cy', 'py')}, {nudged_sql('z', 'pz')} FROM c")
def p20(spark, sf):
    cx, cy, cz = geo.unproject(F.col("x"), F.col("y"), F.col("z"), W, H, FOCAL)
    return z_pixels(spark, sf).select(*PIXEL, nudged(cx, "px"), nudged(cy, "py"), nudged(cz, "pz"))


@query("p21_project", f"WITH {PX}, {_CAM}, m AS (SELECT *, cx - 0.5 AS mx, z - 1.5 AS mz FROM c) SELECT video, frame, y, x, round(CASE WHEN abs(mz) < 0.01 THEN -10.0 ELSE mx / mz * {FOCAL} + {W / 2} END, 6) AS u, round(CASE WHEN abs(mz) < 0.01 THEN -10.0 ELSE cy / mz * {FOCAL} + {H / 2} END, 6) AS v FROM m")
def p21(spark, sf):
    cx, cy, cz = geo.unproject(F.col("x"), F.col("y"), F.col("z"), W, H, FOCAL)
    u, w = geo.project(cx - 0.5, cy, cz - 1.5, W, H, FOCAL)
    return z_pixels(spark, sf).select(*PIXEL, r6(u, "u"), r6(w, "v"))


@query("p22_view_change", f"WITH {PX}, {_CAM}, n AS (SELECT *, greatest(sqrt(cx * cx + cy * cy + z * z), 1e-6) AS la, greatest(sqrt((cx - 1) * (cx - 1) + cy * cy + z * z), 1e-6) AS lb FROM c) SELECT video, frame, y, x, round((cx / la) * ((cx - 1) / lb) + (cy / la) * (cy / lb) + (z / la) * (z / lb), 6) AS cosine, round(dx / ld, 6) AS dx, round(dy / ld, 6) AS dy, round(dz / ld, 6) AS dz FROM (SELECT *, greatest(sqrt(dx * dx + dy * dy + dz * dz), 1e-6) AS ld FROM (SELECT *, cx / la - (cx - 1) / lb AS dx, cy / la - cy / lb AS dy, z / la - z / lb AS dz FROM n))")
def p22(spark, sf):
    c = list(geo.unproject(F.col("x"), F.col("y"), F.col("z"), W, H, FOCAL))
    found = geo.view_direction_change(c, [c[0] - 1, c[1], c[2]])
    return z_pixels(spark, sf).select(*PIXEL, *[r6(f, n) for f, n in zip(found, ("dx", "dy", "dz", "cosine"), strict=True)])


_POSED = f"""{PX}, fr AS (SELECT DISTINCT video, frame, 0.03::DOUBLE * frame + 0.2::DOUBLE * (ascii(video) % 3) AS angle FROM px)"""

_TAE = f"""WITH {_POSED},
z AS (SELECT video, frame, y, x, CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE depth / {v.DEPTH_SCALE} + 1 END AS z, b > 0.01 AS mask FROM px),
n AS (SELECT video, frame, angle, lead(frame) OVER o AS frame2, lead(angle) OVER o AS angle2 FROM fr WINDOW o AS (PARTITION BY video ORDER BY frame)),
p AS (SELECT video, frame, angle, frame2, angle2, frame AS k FROM n WHERE frame2 IS NOT NULL UNION ALL SELECT video, frame2, angle2, frame, angle, frame FROM n WHERE frame2 IS NOT NULL),
c AS (SELECT p.*, y * {W} + x AS src, (x - {W / 2}::DOUBLE) * z / (50 + k) AS cx, (y - {H / 2}::DOUBLE) * z / 50 AS cy, z AS cz FROM z JOIN p USING (video, frame)),
world AS (SELECT *, cos(angle) * cx + sin(angle) * cz + 0.5::DOUBLE * frame - 0.5::DOUBLE * frame2 AS wx, cos(angle) * cz - sin(angle) * cx + 0.25::DOUBLE * frame - 0.25::DOUBLE * frame2 AS wz FROM c),
o AS (SELECT video, frame, frame2, k, src, cos(angle2) * wx - sin(angle2) * wz AS ox, cy AS oy, sin(angle2) * wx + cos(angle2) * wz AS oz FROM world),
l AS (SELECT video, frame, frame2, CAST(round_even(oy * 50 / oz + {H / 2}, 0) AS INTEGER) AS y, CAST(round_even(ox * (50 + k) / oz + {W / 2}, 0) AS INTEGER) AS x, arg_max(oz, src) AS oz FROM o
  WHERE round_even(oy * 50 / oz + {H / 2}, 0) BETWEEN 0 AND {H - 1} AND round_even(ox * (50 + k) / oz + {W / 2}, 0) BETWEEN 0 AND {W - 1} GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT l.video, l.frame, frame2, avg(abs(z - oz) / z) AS e FROM l JOIN z ON z.video = l.video AND z.frame = l.frame2 AND z.y = l.y AND z.x = l.x WHERE oz > 0 AND z > 0 AND mask GROUP BY 1, 2, 3)
SELECT fr.video, round(coalesce(any_value(t) / (2 * (count(*) - 1)), 0) * 100, 6) AS tae FROM fr LEFT JOIN (SELECT video, sum(e) AS t FROM e GROUP BY 1) s ON s.video = fr.video GROUP BY 1"""


@query("a21_tae", _TAE)
def a21(spark, sf):
    z = F.when(F.col("g") == 0, 0.0).otherwise(F.col("depth") / v.DEPTH_SCALE + 1).alias("z")
    px = v.pixels(spark, sf).select(*PIXEL, z, (F.col("b") > 0.01).alias("mask"))
    return posed.temporal_alignment_error(px, v.poses(spark, sf, 0.5, 0.25), W, H).select("video", r6("tae", "tae"))


def _corner_sql(i: int, j: int) -> str:
    """Depth at one corner of a sampled place, and the corner's share."""
    share = f"(CASE WHEN {i} = 1 THEN sv - floor(sv) ELSE 1 - (sv - floor(sv)) END) * (CASE WHEN {j} = 1 THEN su - floor(su) ELSE 1 - (su - floor(su)) END)"
    return f"SELECT id, coalesce(q.z, 0) * {share} AS part FROM s LEFT JOIN z q ON q.video = s.video AND q.frame = s.other AND q.y = floor(sv) + {i} AND q.x = floor(su) + {j}"


_CROSS = f"""WITH {_POSED},
z AS (SELECT video, frame, y, x, 0.6::DOUBLE + depth / 125000 AS z FROM px),
cam AS (SELECT z.*, angle, (x - 32::DOUBLE) * z / 50 - 0.05::DOUBLE * frame AS cx, (y - 16::DOUBLE) * z / 50 AS cy, z - 0.02::DOUBLE * frame AS cz FROM z JOIN fr USING (video, frame)),
world AS (SELECT video, frame, cos(angle) * cx - sin(angle) * cz AS wx, cy AS wy, sin(angle) * cx + cos(angle) * cz AS wz FROM cam),
o AS (SELECT w.video, w.frame, fr.frame AS other, cos(fr.angle) * wx + sin(fr.angle) * wz + 0.05::DOUBLE * fr.frame AS ox, wy AS oy, cos(fr.angle) * wz - sin(fr.angle) * wx + 0.02::DOUBLE * fr.frame AS oz FROM world w JOIN fr USING (video)),
t AS (SELECT video, frame, other, oz, 50 * ox + 32 * oz AS u, 50 * oy + 16 * oz AS v FROM o),
s AS (SELECT video, frame, other, oz, u * {W} / ({W} - 1) - 0.5::DOUBLE AS su, v * {H} / ({H} - 1) - 0.5::DOUBLE AS sv, row_number() OVER () AS id FROM t
  WHERE abs(u / {(W - 1) / 2} - 1) <= 1 + 1e-9::DOUBLE AND abs(v / {(H - 1) / 2} - 1) <= 1 + 1e-9::DOUBLE),
d AS (SELECT id, sum(part) AS sampled FROM ({' UNION ALL '.join(_corner_sql(i, j) for i in (0, 1) for j in (0, 1))}) GROUP BY 1),
e AS (SELECT video, frame, other, avg(abs(sampled - oz)) AS loss FROM s JOIN d USING (id) GROUP BY 1, 2, 3)
SELECT video, round(sum(loss), 6) AS loss FROM e GROUP BY 1"""


@query("j06_cross_view", _CROSS)
def j06(spark, sf):
    px = v.pixels(spark, sf).select(*PIXEL, (F.col("depth") / 125000 + 0.6).alias("z"))
    intrinsics = (50, 0, 32, 0, 0, 50, 16, 0, 0, 0, 1, 0, 0, 0, 0, 1)
    return posed.cross_view_loss(px, v.poses(spark, sf, 0.05, 0.02), intrinsics, W, H).select("video", r6("loss", "loss"))


@query("p28_plane_sweep", f"WITH {PX}, {_CAM} SELECT video, frame, y, x, round(CASE WHEN z - 1.5 <= 0.001 THEN {W}.0 ELSE cx / (z - 1.5) END, 6) AS u, round(CASE WHEN z - 1.5 <= 0.001 THEN {H}.0 ELSE cy / (z - 1.5) END, 6) AS v, round(1 / (1 + exp(-2 * (2 - least(abs(z - 1.5) / 0.1, 4.0)))), 6) AS weight FROM c")
def p28(spark, sf):
    cx, cy, cz = geo.unproject(F.col("x"), F.col("y"), F.col("z"), W, H, FOCAL)
    u, w = geo.plane_sweep(cx, cy, cz - 1.5, W, H)
    return z_pixels(spark, sf).select(*PIXEL, r6(u, "u"), r6(w, "v"), r6(geo.depth_weight(F.col("z") - 1.5, 0.1), "weight"))


@query("a41_splat", f"""WITH {_NORM}, p AS (SELECT video, frame, x - disparity AS u, CAST(y AS DOUBLE) AS v, 1 - near AS z, r AS value, CAST(y * {W} + x AS BIGINT) AS src FROM dp),
o AS (SELECT p.*, CAST(round_even(v, 0) + dy AS INTEGER) AS y, CAST(round_even(u, 0) + dx AS INTEGER) AS x FROM p, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
d AS (SELECT *, (x - u) * (x - u) + (y - v) * (y - v) AS d FROM o WHERE x BETWEEN 0 AND {W - 1} AND y BETWEEN 0 AND {H - 1}),
t AS (SELECT *, 1 - sqrt(least(greatest(d, 1e-3), 1.0)) AS alpha FROM (SELECT *, row_number() OVER (PARTITION BY video, frame, y, x ORDER BY z, src) AS rank FROM d WHERE d <= 1) WHERE rank <= 4),
k AS (SELECT *, alpha * coalesce(exp(sum(ln(greatest(1 - alpha, 1e-300))) OVER (PARTITION BY video, frame, y, x ORDER BY z, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS visible FROM t)
SELECT video, frame, y, x, round(sum(alpha * value), 6) AS wsum, round(CASE WHEN sum(alpha) = 0 THEN 0 ELSE sum(alpha * value) / sum(alpha) END, 6) AS wsumnorm, round(sum(visible * value), 6) AS composite, round(CASE WHEN sum(alpha) = 0 THEN 0 ELSE sum(alpha * z) / sum(alpha) END, 6) AS depth FROM k GROUP BY 1, 2, 3, 4""")
def a41(spark, sf):
    points = disparity_pixels(spark, sf).select("video", "frame", (F.col("x") - F.col("disparity")).alias("u"), F.col("y").cast("double").alias("v"), (1 - F.col("near")).alias("z"), F.col("r").alias("value"), (F.col("y") * W + F.col("x")).cast("long").alias("src"))
    return geo.splat(points, W, H).select(*PIXEL, *r6s("wsum", "wsumnorm", "composite", "depth"))


# Accuracy

_FM = """fm AS (SELECT dataset, scene, frame, count(*) AS n, avg(abs(pred - gt) / gt) AS abs_rel, avg((pred - gt) * (pred - gt) / gt) AS sq_rel, sqrt(avg((pred - gt) * (pred - gt))) AS rmse, sqrt(avg((ln(pred) - ln(gt)) * (ln(pred) - ln(gt)))) AS rmse_log,
 avg(CASE WHEN greatest(pred / gt, gt / pred) < 1.25 THEN 1.0 ELSE 0.0 END) AS d1, avg(CASE WHEN greatest(pred / gt, gt / pred) < 1.5625 THEN 1.0 ELSE 0.0 END) AS d2, avg(CASE WHEN greatest(pred / gt, gt / pred) < 1.953125 THEN 1.0 ELSE 0.0 END) AS d3,
 sqrt(avg((1 / gt - 1 / pred) * (1 / gt - 1 / pred))) AS i_rmse, avg((ln(pred) - ln(gt)) * (ln(pred) - ln(gt))) AS e2, avg(ln(pred) - ln(gt)) AS e1, avg(abs(log10(pred) - log10(gt))) AS log10 FROM al GROUP BY 1, 2, 3),
sc AS (SELECT dataset, scene, avg(abs_rel) AS abs_rel, avg(sq_rel) AS sq_rel, avg(rmse) AS rmse, avg(rmse_log) AS rmse_log, avg(d1) AS d1, avg(d2) AS d2, avg(d3) AS d3, avg(i_rmse) AS i_rmse, sqrt(avg(e2 - e1 * e1)) * 100 AS silog FROM fm GROUP BY 1, 2)"""


def aligned(spark, sf):
    return ev.align(ev.valid(v.pairs(spark, sf)))


def _metric(name, *columns):
    @query(name, f"WITH {PG}, {_FM} SELECT dataset, scene, " + ", ".join(f"round({c}, 6) AS {c}" for c in columns) + " FROM sc")
    def run(spark, sf):
        return ev.scene_metrics(ev.frame_metrics(aligned(spark, sf))).select("dataset", "scene", *r6s(*columns))


_metric("a11_relative_and_rmse", "abs_rel", "sq_rel", "rmse", "rmse_log")
_metric("a13_delta", "d1", "d2", "d3")
_metric("a14_inverse_rmse", "i_rmse")
_metric("a15_silog", "silog")


@query("a12_log10_pooled", f"WITH {PG} SELECT dataset, scene, round(avg(abs(log10(pred) - log10(gt))), 6) AS log10 FROM al GROUP BY 1, 2")
def a12(spark, sf):
    return ev.pooled_log10(aligned(spark, sf)).select("dataset", "scene", r6("log10", "log10"))


_NINE = ("d1", "d2", "d3", "abs_rel", "sq_rel", "rmse", "rmse_log", "log10", "silog")


@query("a16_image_metrics", f"WITH {PG}, {_FM} SELECT dataset, " + ", ".join(f"round(avg({'sqrt(e2 - 0.5 * e1 * e1)' if c == 'silog' else c}), 6) AS {c}" for c in _NINE) + " FROM fm GROUP BY 1")
def a16(spark, sf):
    return ev.image_metrics_mean(aligned(spark, sf)).select("dataset", *r6s(*_NINE))


@query("a18_aligned_eval", f"WITH {PG}, {_FM} SELECT dataset, round(avg(abs_rel), 6) AS abs_rel, round(avg(rmse), 6) AS rmse, round(avg(d1), 6) AS d1 FROM sc GROUP BY 1")
def a18(spark, sf):
    scenes = ev.scene_metrics(ev.frame_metrics(aligned(spark, sf)))
    return ev.mean_over(scenes, ("abs_rel", "rmse", "d1")).select("dataset", *r6s("abs_rel", "rmse", "d1"))


@query("f03_min_valid", f"WITH {PG}, i AS (SELECT * FROM pg WHERE gt BETWEEN 1 AND 30) SELECT dataset, scene, frame, count(*) AS n FROM i GROUP BY 1, 2, 3 HAVING count(*) >= 10")
def f03(spark, sf):
    return ev.valid_inclusive(v.pairs(spark, sf), 1, 30).groupBy("dataset", "scene", "frame").agg(F.count("*").alias("n"))


@query("a19_scale_shift", f"""WITH {PG}, s AS (SELECT dataset, scene, sum(gt * gt) AS pp, sum(gt) AS sp, CAST(count(*) AS DOUBLE) AS n, sum(gt * pred) AS pt, sum(pred) AS st FROM al GROUP BY 1, 2), d AS (SELECT *, pp * n - sp * sp AS det FROM s)
SELECT dataset, scene, round(CASE WHEN det = 0 THEN 1.0 ELSE (n * pt - sp * st) / det END, 6) AS infer_scale, round(CASE WHEN det = 0 THEN 0.0 ELSE (-sp * pt + pp * st) / det END, 6) AS infer_shift, round(CASE WHEN det = 0 THEN 0.0 ELSE (n * pt - sp * st) / (det + 1e-6) END, 6) AS loss_scale, round(CASE WHEN det = 0 THEN 0.0 ELSE (-sp * pt + pp * st) / (det + 1e-6) END, 6) AS loss_shift, round(pt / (pp + 1e-6), 6) AS only_scale FROM d""")
def a19(spark, sf):
    return ev.scale_shift(aligned(spark, sf), pred="gt", target="pred").select("dataset", "scene", *r6s("infer_scale", "infer_shift", "loss_scale", "loss_shift", "only_scale"))


@query("a22_robust_norm", f"WITH {PX}, m AS (SELECT video, frame, quantile_disc(CASE WHEN r > 10 THEN depth ELSE 0.0 END, 0.5) AS middle FROM px GROUP BY 1, 2) SELECT video, frame, round(any_value(middle), 6) AS middle, round(greatest(coalesce(sum(abs(depth - middle)) FILTER (r > 10) / count(*) FILTER (r > 10), 0), 1e-6), 6) AS spread FROM px JOIN m USING (video, frame) GROUP BY 1, 2")
def a22(spark, sf):
    px = v.pixels(spark, sf).withColumn("mask", F.col("r") > 10)
    return ev.robust_bounds(px, "depth").select("video", "frame", *r6s("middle", "spread"))


@query("a23_reductions", f"WITH {PG}, {_FM} SELECT dataset, round(sum(abs_rel * n) / sum(n), 6) AS batch, round(avg(abs_rel), 6) AS image FROM fm GROUP BY 1")
def a23(spark, sf):
    images = ev.frame_metrics(aligned(spark, sf)).withColumn("loss", F.col("abs_rel") * F.col("n"))
    return ev.batch_and_image_means(images).select("dataset", *r6s("batch", "image"))


@query("a24_trimmed_mae", f"WITH {PG}, k AS (SELECT dataset, scene, abs(pred - gt) AS res, row_number() OVER (PARTITION BY dataset, scene ORDER BY abs(pred - gt)) AS rank, count(*) OVER (PARTITION BY dataset, scene) AS n FROM al) SELECT dataset, scene, round(sum(CASE WHEN rank <= floor(n * (1 - 0.2::DOUBLE)) THEN res ELSE 0.0 END) / max(n), 6) AS loss FROM k GROUP BY 1, 2")
def a24(spark, sf):
    return ev.trimmed_mae(aligned(spark, sf)).select("dataset", "scene", r6("loss", "loss"))


def gradient_sql(rows: str, value: str, keys: str, mask: str) -> str:
    """A table of keys and loss: neighbours meet by self-joins on each stride's grid."""
    on = "b.video = a.video AND b.frame = a.frame"
    parts = []
    for s in (1, 2, 4, 8):
        grid = f"(SELECT * FROM {rows} WHERE y % {s} = 0 AND x % {s} = 0 AND {mask})"
        steps = [f"SELECT a.video, a.frame, abs(a.{value} - b.{value}) AS g, 0 AS n FROM {grid} a JOIN {grid} b ON {on} AND b.y = a.y + {dy} AND b.x = a.x + {dx}" for dy, dx in ((0, s), (s, 0))]
        known = f"SELECT video, frame, 0.0::DOUBLE AS g, 1 AS n FROM {grid}"
        parts.append(f"SELECT {keys}, sum(g) / sum(n) AS part FROM ({' UNION ALL '.join([*steps, known])}) GROUP BY ALL")
    return f"SELECT {keys}, sum(part) AS loss FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query("a25_gradient_loss", f"WITH {PX} SELECT video, frame, round(loss, 6) AS loss FROM ({gradient_sql('px', 'r', 'video, frame', 'g > 0.03')})")
def a25(spark, sf):
    return ev.gradient_loss(v.pixels(spark, sf).withColumn("mask", F.col("g") > 0.03), "r", mask="mask").select("video", "frame", r6("loss", "loss"))


@query("a25_gradient_loss_pooled", f"WITH {PX} SELECT video, round(loss, 6) AS loss FROM ({gradient_sql('px', 'r', 'video', 'g > 0.03')})")
def a25_pooled(spark, sf):
    return ev.gradient_loss(v.pixels(spark, sf).withColumn("mask", F.col("g") > 0.03), "r", keys=("video",), mask="mask").select("video", r6("loss", "loss"))


def temporal_sql(rows: str, scales: int, trim: float, mask: str) -> str:
    """A table of video and loss; ``rows`` has video, frame, y, x, pred, target. Frames meet by self-joins."""
    parts = []
    for i in range(scales):
        s = 2**i
        strided = f"(SELECT r.*, r.frame - sp.f0 AS i FROM {rows} r JOIN span sp USING (video) WHERE (r.frame - sp.f0) % {s} = 0 AND sp.t > {s} AND {mask})"
        parts.append(f"""SELECT video, sum(CASE WHEN rank <= floor(n * (1 - {trim}::DOUBLE)) THEN res ELSE 0.0 END) / max(n) * {0.5**i}::DOUBLE AS part FROM (
  SELECT video, res, row_number() OVER (PARTITION BY video ORDER BY res) AS rank, count(*) OVER (PARTITION BY video) AS n FROM (
    SELECT a.video, abs((a.pred - b.pred) - (a.target - b.target)) AS res FROM {strided} a JOIN {strided} b ON b.video = a.video AND b.i = a.i - {s} AND b.y = a.y AND b.x = a.x
    JOIN most m ON m.video = a.video AND m.frame = a.frame WHERE abs(a.target - b.target) < m.most)) GROUP BY 1""")
    return f"""WITH span AS (SELECT video, min(frame) AS f0, max(frame) - min(frame) + 1 AS t FROM {rows} GROUP BY 1),
most AS (SELECT video, frame, (max(target) - min(target)) * 0.05::DOUBLE AS most FROM {rows} WHERE {mask} GROUP BY 1, 2)
SELECT span.video, coalesce(sum(part), 0) / any_value({' + '.join(f'CAST(t > {2**i} AS INTEGER)' for i in range(scales))}) AS loss FROM span LEFT JOIN ({' UNION ALL '.join(parts)}) p USING (video) WHERE t > 1 GROUP BY 1"""


RATED = f"{PX}, e AS (SELECT video, frame, y, x, r / 50 AS pred, depth / {v.DEPTH_SCALE} AS target, g > 0.03 AS mask FROM px)"


def rated(spark, sf) -> DataFrame:
    return v.pixels(spark, sf).select(*PIXEL, (F.col("r") / 50).alias("pred"), (F.col("depth") / v.DEPTH_SCALE).alias("target"), (F.col("g") > 0.03).alias("mask"))


@query("a27_temporal_gradient", f"WITH {RATED} SELECT video, round(loss, 6) AS loss FROM ({temporal_sql('e', 4, 0.2, 'mask')})")
def a27(spark, sf):
    return ev.temporal_gradient_loss(rated(spark, sf), mask="mask").select("video", r6("loss", "loss"))


_MAE = f"{_NORM}, {_RIGHT}, mae AS (SELECT video, frame, sum(abs(px.r - rp.r) + abs(px.g - rp.g) + abs(px.b - rp.b)) / (3 * count(*)) AS mae FROM px JOIN rp USING (video, frame, y, x) GROUP BY 1, 2)"


@query("a29_stereo_mae", f"WITH {_MAE} SELECT video, round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS deviation FROM mae GROUP BY 1")
def a29(spark, sf):
    each = ev.stereo_mae(v.pixels(spark, sf), right_view(spark, sf))
    return each.groupBy("video").agg(r6(F.avg("mae"), "mean"), r6(F.stddev_samp("mae"), "deviation"))


@query("a29_stereo_mae_running", f"WITH {_MAE} SELECT video, frame, round(avg(mae) OVER w, 6) AS mean FROM mae WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def a29r(spark, sf):
    from pyspark.sql import Window

    upto = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return ev.stereo_mae(v.pixels(spark, sf), right_view(spark, sf)).select("video", "frame", r6(F.avg("mae").over(upto), "mean"))


@query("a30_psnr", f"WITH {_NORM}, {_RIGHT} SELECT video, frame, round(10.0 * log10(1 / avg((px.r - rp.r) * (px.r - rp.r) + (px.g - rp.g) * (px.g - rp.g) + (px.b - rp.b) * (px.b - rp.b))), 6) AS psnr FROM px JOIN rp USING (video, frame, y, x) GROUP BY 1, 2")
def a30(spark, sf):
    right = right_view(spark, sf).select(*PIXEL, *[F.col(c).alias(f"{c}2") for c in "rgb"])
    return ev.psnr(v.pixels(spark, sf).join(right, PIXEL)).select("video", "frame", r6("psnr", "psnr"))


def _ssim_sql(masked: bool = False) -> str:
    weights = ev.gaussian()
    names = ("gx", "gy", "gxx", "gyy", "gxy")
    blur = lambda: ", ".join("(" + " + ".join(f"coalesce(lag({n}, {5 - i}) OVER w, 0) * {w!r}" for i, w in enumerate(weights)) + f") AS {n}" for n in names)
    value = "(2 * gx * gy + 1e-4) * (2 * (gxy - gx * gy) + 9e-4) / ((gx * gx + gy * gy + 1e-4) * (gxx - gx * gx + gyy - gy * gy + 9e-4))"
    mean = f"sum(mask * {value}) / greatest(sum(mask), 1)" if masked else f"avg({value})"
    return f"""WITH {PX}, {DENSE}, s AS (SELECT video, frame, y, x, g AS gx, b AS gy, g * g AS gxx, b * b AS gyy, g * b AS gxy, CASE WHEN hole THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask FROM dense),
a AS (SELECT video, frame, y, x, mask, {blur()} FROM s WINDOW w AS (PARTITION BY video, frame, y ORDER BY x)),
c AS (SELECT video, frame, y, x, mask, {blur()} FROM a WINDOW w AS (PARTITION BY video, frame, x ORDER BY y))
SELECT video, frame, round({mean}, 6) AS ssim FROM c GROUP BY 1, 2"""


@query("a32_ssim", _ssim_sql())
def a32(spark, sf):
    return ev.ssim(dense_pixels(spark, sf), "g", "b").select("video", "frame", r6("ssim", "ssim"))


@query("a37_depth_losses", f"WITH {PG} SELECT dataset, scene, round(avg(abs(pred - gt)), 6) AS l1, round(avg((pred - gt) * (pred - gt)), 6) AS l2, round(avg(CASE WHEN abs(pred - gt) < 1 THEN 0.5 * abs(pred - gt) * abs(pred - gt) ELSE abs(pred - gt) - 0.5 END), 6) AS smooth FROM al GROUP BY 1, 2")
def a37(spark, sf):
    return ev.depth_losses(aligned(spark, sf)).select("dataset", "scene", *r6s("l1", "l2", "smooth"))


# Features

_VEC = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def vectors(spark, sf):
    return v.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("p24_pos_encoding", f"WITH {_VEC}, p AS (SELECT vec_id, unnest([0, 1, 2]) AS i, v FROM e), k AS (SELECT vec_id, i, v[i + 1] AS c, unnest([0, 1, 2, 3]) AS k FROM p) SELECT vec_id, i, k, round(sin(pow(2.0, k) * pi() * c), 6) AS s, round(cos(pow(2.0, k) * pi() * c), 6) AS c FROM k")
def p24(spark, sf):
    parts = vectors(spark, sf).select("vec_id", F.posexplode(F.slice("v", 1, 3)).alias("i", "x")).withColumn("e", fn.positional_encoding(F.col("x"), 4))
    each = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return each.select("vec_id", "i", "k", r6(F.get("e", F.col("k") * 2), "s"), r6(F.get("e", F.col("k") * 2 + 1), "c"))


@query("p25_rotary", f"WITH {_VEC} SELECT vec_id, round(v[1] * cos(vec_id * 0.1) - v[2] * sin(vec_id * 0.1), 6) AS a, round(v[1] * sin(vec_id * 0.1) + v[2] * cos(vec_id * 0.1), 6) AS b FROM e")
def p25(spark, sf):
    a, b = fn.rotary(F.get("v", F.lit(0)), F.get("v", F.lit(1)), F.col("vec_id") * 0.1)
    return vectors(spark, sf).select("vec_id", r6(a, "a"), r6(b, "b"))


@query("a33_cosine", f"WITH {_VEC}, p AS (SELECT vec_id, label, unnest(v) AS c, unnest(range(64)) AS i FROM e), m AS (SELECT label, i, avg(c) AS m FROM p GROUP BY 1, 2) SELECT label, vec_id, round(sum(c * m) / greatest(sqrt(sum(c * c)) * sqrt(sum(m * m)), 1e-10), 6) AS cosine FROM p JOIN m USING (label, i) GROUP BY 1, 2")
def a33(spark, sf):
    return ft.cosine_to_centre(vectors(spark, sf), "label", "v", "vec_id").select("label", "vec_id", r6("cosine", "cosine"))


@query("a34_gram", f"WITH {_VEC}, t AS (SELECT vec_id, label, v, unnest(range(8)) AS place FROM e), p AS (SELECT vec_id, label, place, unnest(range(8)) AS i, v FROM t), c AS (SELECT vec_id, label, place, i, v[8 * i + place + 1] AS c FROM p) SELECT a.label, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, CASE WHEN abs(avg(a.c * b.c)) < 5e-7 THEN 0.0::DOUBLE ELSE round(avg(a.c * b.c), 6) END AS g FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.place = b.place AND a.i <= b.i GROUP BY 1, 2, 3")
def a34(spark, sf):
    # A vector as a map of 8 channels over 8 places.
    channels = lambda place: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("v", i * 8 + place))
    maps = vectors(spark, sf).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("v", channels(F.col("place")))
    return ft.gram(maps, "label", "v", 8).select("label", "i", "j", F.when(F.abs("g") < 5e-7, 0.0).otherwise(F.round("g", 6)).alias("g"))


@query("a34_gram_channels", f"WITH {_VEC}, p AS (SELECT vec_id, label, unnest(v) AS c, unnest(range(64)) AS i FROM e) SELECT a.label, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, CASE WHEN abs(avg(a.c * b.c)) < 5e-7 THEN 0.0::DOUBLE ELSE round(avg(a.c * b.c), 6) END AS g FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2, 3")
def a34c(spark, sf):
    # What rounds to 0 has no sign: it would hang on the order of the sum.
    return ft.gram(vectors(spark, sf), "label", "v", 64).select("label", "i", "j", F.when(F.abs("g") < 5e-7, 0.0).otherwise(F.round("g", 6)).alias("g"))


_SOFT = f"{_VEC}, h AS (SELECT vec_id, unnest(v[1:16]) AS c, unnest(range(16)) AS i FROM e), s AS (SELECT vec_id, i, exp(c - max(c) OVER w) AS e FROM h WINDOW w AS (PARTITION BY vec_id)), pr AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s)"


@query("a39_soft_argmin", f"WITH {_SOFT} SELECT vec_id, round(sum(p * (1 + 0.5 * i)), 6) AS depth, round(1 / sum(p / (1 + 0.5 * i)), 6) AS inverse FROM pr GROUP BY 1")
def a39(spark, sf):
    depths = F.array(*[F.lit(1 + 0.5 * i) for i in range(16)])
    inverses = F.array(*[F.lit(1 / (1 + 0.5 * i)) for i in range(16)])
    soft = vectors(spark, sf).withColumn("p", ft.softmax(F.slice("v", 1, 16)))
    return soft.select("vec_id", r6(ft.expectation(F.col("p"), depths), "depth"), r6(1 / ft.expectation(F.col("p"), inverses), "inverse"))


@query("a40_group_correlation", f"WITH {_VEC}, p AS (SELECT vec_id, unnest(v[1:32]) AS a, unnest(v[33:64]) AS b, unnest(range(32)) AS i FROM e) SELECT vec_id, CAST(i // 8 AS INTEGER) AS g, round(avg(a * b), 6) AS c FROM p GROUP BY 1, 2")
def a40(spark, sf):
    c = ft.group_correlation(F.slice("v", 1, 32), F.slice("v", 33, 32), 4, 32)
    return vectors(spark, sf).select("vec_id", F.posexplode(c).alias("g", "c")).select("vec_id", "g", r6("c", "c"))


@query("a43_attention", f"""WITH {_VEC}, k AS (SELECT vec_id // 8 AS scene, vec_id, v FROM e),
s AS (SELECT q.scene, q.vec_id, list_inner_product(q.v, k.v) / sqrt(64.0) AS s, k.v[1] AS val FROM k q JOIN k ON k.scene = q.scene), x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY scene, vec_id)) AS e FROM s)
SELECT scene, vec_id, CASE WHEN abs(sum(e * val) / sum(e)) < 5e-7 THEN 0.0::DOUBLE ELSE round(sum(e * val) / sum(e), 6) END AS out FROM x GROUP BY 1, 2""")
def a43(spark, sf):
    # Eight vectors after one another are the views of a scene; all of them are queries and keys.
    rows = vectors(spark, sf).withColumn("scene", F.floor(F.col("vec_id") / 8)).withColumn("value", F.get("v", F.lit(0)))
    return ft.attention(rows, rows, "scene", "vec_id", "v", "value", 64).select("scene", "vec_id", F.when(F.abs("out") < 5e-7, 0.0).otherwise(F.round("out", 6)).alias("out"))


@query("a43_attention_positions", f"""WITH {_VEC}, t AS (SELECT vec_id, unnest(range(8)) AS pos, v FROM e), h AS (SELECT vec_id, pos, v[8 * pos + 1 : 8 * pos + 8] AS v FROM t),
s AS (SELECT q.vec_id, q.pos, list_inner_product(q.v, k.v) / sqrt(8.0) AS s, k.v[1] AS val FROM h q JOIN h k ON k.vec_id = q.vec_id), x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id, pos)) AS e FROM s)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(sum(e * val) / sum(e), 6) AS out FROM x GROUP BY 1, 2""")
def a43p(spark, sf):
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))
    rows = vectors(spark, sf).select("vec_id", F.posexplode(parts).alias("pos", "v")).withColumn("value", F.get("v", F.lit(0)))
    return ft.attention(rows, rows, "vec_id", "pos", "v", "value", 8).select("vec_id", "pos", r6("out", "out"))


@query("a44_batch_moments", f"WITH {_VEC}, p AS (SELECT unnest(v) AS c, unnest(range(64)) AS i FROM e) SELECT CAST(i AS INTEGER) AS i, round(avg(c), 6) AS mean, round(var_pop(c), 6) AS var_biased, round(var_samp(c), 6) AS var_unbiased FROM p GROUP BY 1")
def a44(spark, sf):
    return ft.moments(vectors(spark, sf), "v").select("i", *r6s("mean", "var_biased", "var_unbiased"))


@query("a49_confidence", f"WITH {_SOFT}, d AS (SELECT vec_id, CAST(trunc(sum(p * i)) AS INTEGER) AS d FROM pr GROUP BY 1) SELECT vec_id, round(sum(p), 6) AS confidence FROM pr JOIN d USING (vec_id) WHERE i BETWEEN d - 1 AND d + 2 GROUP BY 1")
def a49(spark, sf):
    soft = vectors(spark, sf).withColumn("p", ft.softmax(F.slice("v", 1, 16)))
    return soft.select("vec_id", r6(ft.photometric_confidence(F.col("p")), "confidence"))


@query("o05_sorted_hypotheses", f"WITH {_VEC} SELECT vec_id, round(list_sort(v)[1], 6) AS least, round(list_sort(v)[32], 6) AS middle FROM e")
def o05(spark, sf):
    ordered = F.array_sort("v")
    return vectors(spark, sf).select("vec_id", r6(F.get(ordered, F.lit(0)), "least"), r6(F.get(ordered, F.lit(31)), "middle"))


# Time


@query("a46_stage_report", f"WITH {FR}, s AS (SELECT type AS stage, sum(value) AS seconds FROM fr GROUP BY 1) SELECT stage, round(seconds, 4) AS seconds, round(seconds / sum(seconds) OVER (), 6) AS share FROM s")
def a46(spark, sf):
    rows = v.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return tp.stage_report(rows).select("stage", F.round("seconds", 4).alias("seconds"), r6("share", "share"))


@query("a47_best_so_far", f"WITH {FR} SELECT video, idx, max(value) OVER w AS best FROM fr WINDOW w AS (PARTITION BY video ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def a47(spark, sf):
    return tp.best_so_far(v.frame_stream(spark, sf), "value", "max").select("video", "idx", "best")


_EMA = f"WITH RECURSIVE {FR}, em AS (SELECT video, idx, value AS smoothed FROM fr WHERE idx = 0 UNION ALL SELECT f.video, f.idx, 0.75 * f.value + 0.25 * e.smoothed FROM em e JOIN fr f ON f.video = e.video AND f.idx = e.idx + 1) SELECT video, idx, {nudged_sql('smoothed', 'smoothed')} FROM em"


@query("w01_ema", _EMA)
def w01(spark, sf):
    return tp.ema(v.frame_stream(spark, sf), 0.75).select("video", "idx", nudged("smoothed", "smoothed"))


@query("w01_ema_long", _EMA.replace("SELECT video, idx, round", "SELECT video, CAST(idx AS BIGINT) AS idx, round"))
def w01l(spark, sf):
    return tp.ema_long(v.frame_stream(spark, sf), 0.75).select("video", "idx", nudged("smoothed", "smoothed"))


def lengths(spark, sf):
    return v.table(spark, sf, "events").groupBy(F.col("user_id").alias("video")).agg(F.count("*").alias("n"))


_LEN = "ln AS (SELECT user_id AS video, count(*) AS n FROM events GROUP BY 1)"


@query("w03_windows", f"WITH {_LEN}, w AS (SELECT video, n, unnest(range(CAST(ceil(n / 22.0) AS BIGINT))) AS k FROM ln), s AS (SELECT *, unnest(range(32)) AS j FROM w) SELECT video, CAST(k AS INTEGER) AS \"window\", CAST(j AS INTEGER) AS slot, CAST(CASE WHEN k > 0 AND j = 0 THEN 0 WHEN k > 0 AND j = 1 THEN 22 * k - 10 ELSE least(22 * k + j, n - 1) END AS INTEGER) AS frame FROM s")
def w03(spark, sf):
    return tp.windows(lengths(spark, sf))


#: Windows' predictions are the values times the window's number, plus it; the chain undoes that window after window.
_CHAIN = f"""WITH RECURSIVE {FR}, {_LEN},
g AS (SELECT video, n, unnest(range(CAST(ceil(n / 22.0) AS BIGINT))) AS k FROM ln),
j AS (SELECT *, unnest(range(32)) AS slot FROM g),
sl AS (SELECT video, k, slot, CASE WHEN k > 0 AND slot = 0 THEN 0 WHEN k > 0 AND slot = 1 THEN 22 * k - 10 ELSE least(22 * k + slot, n - 1) END AS idx FROM j),
val AS (SELECT sl.video, k, slot, value * (k + 1) + k AS v FROM sl JOIN fr ON fr.video = sl.video AND fr.idx = sl.idx),
p AS (SELECT video, k, max(v) FILTER (slot = 0) AS a, max(v) FILTER (slot = 1) AS b, max(v) FILTER (slot = 12) AS c FROM val GROUP BY 1, 2),
chain AS (
  SELECT video, k, 1.0::DOUBLE AS s, 0.0::DOUBLE AS t, a AS r0, c AS r1 FROM p WHERE k = 0
  UNION ALL
  SELECT video, k, s, t, r0, greatest(c * s + t, 0) AS r1 FROM (
    SELECT p.video, p.k, p.c, h.r0,
           CASE WHEN a = b THEN 1.0 ELSE (2 * (a * r0 + b * r1) - (a + b) * (r0 + r1)) / (2 * (a * a + b * b) - (a + b) * (a + b)) END AS s,
           CASE WHEN a = b THEN 0.0 ELSE ((a * a + b * b) * (r0 + r1) - (a + b) * (a * r0 + b * r1)) / (2 * (a * a + b * b) - (a + b) * (a + b)) END AS t
    FROM chain h JOIN p ON p.video = h.video AND p.k = h.k + 1)),
al AS (SELECT video, k, slot, 22 * k + slot AS idx, CASE WHEN k = 0 THEN v ELSE greatest(v * s + t, 0) END AS v FROM val JOIN chain USING (video, k)),
faded AS (SELECT n.video, n.idx, o.v * (1 - (n.slot - 2) / 7.0::DOUBLE) + n.v * ((n.slot - 2) / 7.0::DOUBLE) AS v FROM al n JOIN al o ON o.video = n.video AND o.k = n.k - 1 AND o.idx = n.idx WHERE n.slot BETWEEN 2 AND 9),
whole AS (SELECT al.video, al.idx, coalesce(f.v, al.v) AS v FROM al LEFT JOIN faded f ON f.video = al.video AND f.idx = al.idx WHERE al.k = 0 OR al.slot > 9)
SELECT video, CAST(idx AS BIGINT) AS frame, round(v, 4) AS value FROM whole JOIN ln USING (video) WHERE idx < n"""


@query("w05_alignment_chain", _CHAIN)
def w05(spark, sf):
    values = v.frame_stream(spark, sf).select("video", F.col("idx").alias("frame"), "value")
    given = tp.windows(lengths(spark, sf)).join(values, ["video", "frame"]).withColumn("value", F.col("value") * (F.col("window") + 1) + F.col("window"))
    return tp.align_windows(given).select("video", "frame", F.round("value", 4).alias("value"))


@query("w06_cross_fade", f"WITH {FR} SELECT video, idx, round(value * (1 - (idx % 8) / 7.0::DOUBLE) + (value + 10) * ((idx % 8) / 7.0::DOUBLE), 6) AS faded FROM fr")
def w06(spark, sf):
    rows = v.frame_stream(spark, sf).withColumn("j", F.col("idx") % 8).withColumn("before", F.col("value")).withColumn("after", F.col("value") + 10)
    return tp.cross_fade(rows).select("video", "idx", r6("faded", "faded"))


@query("w07_cache_slots", f"WITH {_LEN}, t AS (SELECT video, unnest(range(1, n)) AS t FROM ln WHERE n > 1), s AS (SELECT *, unnest(range(31)) AS j FROM t) SELECT video, CAST(t AS INTEGER) AS t, CAST(j AS INTEGER) AS slot, CAST(CASE WHEN j = 0 THEN 0 WHEN j = 1 THEN greatest(t - 41, 0) ELSE greatest(t - (31 - j), 0) END AS INTEGER) AS frame FROM s")
def w07(spark, sf):
    return tp.cache_slots(lengths(spark, sf))


@query("w08_tap_pool", f"WITH {FR} SELECT video, idx, " + ", ".join(
    f"value AS tap_{i}" if t == 0 else f"coalesce({'lag' if t < 0 else 'lead'}(value, {abs(t)}) OVER (PARTITION BY video ORDER BY idx), {'first' if t < 0 else 'last'}_value(value) OVER (PARTITION BY video ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS tap_{i}" for i, t in enumerate((-5, -1, 0, 1, 5))
) + " FROM fr")
def w08(spark, sf):
    return tp.tap_pool(v.frame_stream(spark, sf)).select("video", "idx", *[f"tap_{i}" for i in range(5)])


@query("w15_frame_slice", f"WITH {FR} SELECT video, idx, value FROM fr WHERE idx >= 2 AND idx < 30 AND (idx - 2) % 3 = 0")
def w15(spark, sf):
    return tp.slice_frames(v.frame_stream(spark, sf), 2, 30, 3).select("video", "idx", "value")


@query("w16_topn", f"WITH {FR} SELECT video, idx, value FROM fr WHERE idx < 5")
def w16(spark, sf):
    return ft.trimmed_top(v.frame_stream(spark, sf), "video", [F.col("idx")], 5).select("video", "idx", "value")


@query("f09_whole_chunks", f"WITH {FR}, {_LEN} SELECT video, idx, CAST(idx // 4 AS INTEGER) AS chunk FROM fr JOIN ln USING (video) WHERE (idx // 4 + 1) * 4 <= n")
def f09(spark, sf):
    return tp.whole_chunks(v.frame_stream(spark, sf), 4).select("video", "idx", "chunk")


# Resampling


def _bilinear_sql(h, w, nh, nw, corners):
    def at(t, s, n):
        return f"({t} * {s - 1} / {n - 1}.0::DOUBLE)" if corners else f"greatest(({t} + 0.5) * {s} / {n}.0::DOUBLE - 0.5, 0.0)"

    axis = lambda name, s, n: f"{name} AS (SELECT range AS t, CAST(least(floor({at('range', s, n)}), {s - 1}) AS INTEGER) AS lo, CAST(least(floor({at('range', s, n)}) + 1, {s - 1}) AS INTEGER) AS hi, {at('range', s, n)} - least(floor({at('range', s, n)}), {s - 1}) AS f FROM range({n}))"
    corner = lambda y, x: f"dense {y}{x} ON {y}{x}.video = fs.video AND {y}{x}.frame = fs.frame AND {y}{x}.y = ya.{y} AND {y}{x}.x = xa.{x}"
    return f"""WITH {PX}, {DENSE}, {axis('ya', h, nh)}, {axis('xa', w, nw)}, fs AS (SELECT DISTINCT video, frame FROM px)
SELECT fs.video, fs.frame, CAST(ya.t AS INTEGER) AS y, CAST(xa.t AS INTEGER) AS x, {nudged_sql('(lolo.depth * (1 - xa.f) + lohi.depth * xa.f) * (1 - ya.f) + (hilo.depth * (1 - xa.f) + hihi.depth * xa.f) * ya.f', 'depth', 3)}
FROM fs CROSS JOIN ya CROSS JOIN xa JOIN {corner('lo', 'lo')} JOIN {corner('lo', 'hi')} JOIN {corner('hi', 'lo')} JOIN {corner('hi', 'hi')}"""


@query("r01_resize_half_pixel", _bilinear_sql(H, W, 20, 100, False))
def r01(spark, sf):
    return rs.bilinear(dense_pixels(spark, sf), H, W, 20, 100).select(*PIXEL, nudged("depth", "depth", 3))


@query("r02_align_corners", _bilinear_sql(H, W, 48, 40, True))
def r02(spark, sf):
    return rs.bilinear(dense_pixels(spark, sf), H, W, 48, 40, align_corners=True).select(*PIXEL, nudged("depth", "depth", 3))


@query("r03_bilinear_sample", f"""WITH {PX}, {DENSE}, p AS (SELECT video, frame, CAST(y * {W} + x AS BIGINT) AS id, x + 0.25 AS u, y - 0.75 AS v FROM px),
c AS (SELECT p.*, CAST(floor(u) + i AS INTEGER) AS x, CAST(floor(v) + j AS INTEGER) AS y, (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT c.video, c.frame, c.id, {nudged_sql('sum(coalesce(d.depth, 0) * c.w)', 'sampled', 3)} FROM c LEFT JOIN dense d ON d.video = c.video AND d.frame = c.frame AND d.y = c.y AND d.x = c.x GROUP BY 1, 2, 3""")
def r03(spark, sf):
    places = v.pixels(spark, sf).select("video", "frame", (F.col("y") * W + F.col("x")).cast("long").alias("id"), (F.col("x") + 0.25).cast("double").alias("u"), (F.col("y") - 0.75).cast("double").alias("v"))
    return rs.sample(dense_pixels(spark, sf), places, H, W).select("video", "frame", "id", nudged("sampled", "sampled", 3))


@query("r04_nearest", f"WITH {PX}, {DENSE} SELECT d.video, d.frame, CAST(ty.range AS INTEGER) AS y, CAST(tx.range AS INTEGER) AS x, d.depth FROM dense d JOIN range(20) ty ON d.y = ty.range * {H} // 20 JOIN range(100) tx ON d.x = tx.range * {W} // 100")
def r04(spark, sf):
    return rs.nearest(dense_pixels(spark, sf), H, W, 20, 100).select(*PIXEL, "depth")


@query("r05_area", f"WITH {PX}, {DENSE} SELECT video, frame, CAST(y // 4 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, {nudged_sql('avg(depth)', 'depth', 4)} FROM dense GROUP BY 1, 2, 3, 4")
def r05(spark, sf):
    return rs.area(dense_pixels(spark, sf), 4).select(*PIXEL, nudged("depth", "depth", 4))


def _bicubic_sql(h, w, nh, nw):
    """Four taps an axis, edges repeated, weights of each target summing to one."""
    def axis(name, s, n):
        at = f"((range + 0.5) * {s} / {n}.0::DOUBLE - 0.5)"
        return f"""{name}0 AS (SELECT range AS t, least(greatest(CAST(floor({at}) AS INTEGER) + o, 0), {s - 1}) AS src, abs({at} - (floor({at}) + o)) AS d FROM range({n}), (SELECT unnest([-1, 0, 1, 2]) AS o)),
{name} AS (SELECT t, src, f / sum(f) OVER (PARTITION BY t) AS f FROM (SELECT t, src, CASE WHEN d <= 1 THEN 1.25::DOUBLE * d * d * d - 2.25::DOUBLE * d * d + 1 WHEN d < 2 THEN -0.75::DOUBLE * d * d * d + 3.75::DOUBLE * d * d - 6 * d + 3 ELSE 0 END AS f FROM {name}0))"""

    return f"""WITH {PX}, {DENSE}, {axis('ya', h, nh)}, {axis('xa', w, nw)}
SELECT d.video, d.frame, CAST(ya.t AS INTEGER) AS y, CAST(xa.t AS INTEGER) AS x, {nudged_sql('sum(d.depth * ya.f * xa.f)', 'depth', 3)} FROM dense d JOIN ya ON ya.src = d.y JOIN xa ON xa.src = d.x GROUP BY 1, 2, 3, 4"""


@query("r06_bicubic", _bicubic_sql(H, W, 24, 48))
def r06(spark, sf):
    return rs.resample(dense_pixels(spark, sf), H, W, 24, 48).select(*PIXEL, nudged("depth", "depth", 3))


@query("r09_pyramid", f"WITH {PX}, {DENSE} SELECT f AS factor, video, frame, CAST(y // f AS INTEGER) AS y, CAST(x // f AS INTEGER) AS x, depth FROM dense, (SELECT unnest([2, 4, 8]) AS f) WHERE y % f = 0 AND x % f = 0")
def r09(spark, sf):
    return rs.pyramid(dense_pixels(spark, sf))


@query("t01_stream_ema", _EMA.replace("SELECT video, idx, round", "SELECT CAST(video AS BIGINT) AS video, CAST(idx AS BIGINT) AS idx, round") + " QUALIFY row_number() OVER (PARTITION BY video ORDER BY idx DESC) = 1")
def t01(spark, sf):
    """Final smoothed value of each video, by the stream."""
    from framelake.plans.streams import smoothed_events, stream_folder

    return smoothed_events(spark, sf, stream_folder(spark)).select("video", "idx", nudged("smoothed", "smoothed"))


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _windowed(kind, sql):
    @query(f"t08_stream_{kind}", sql)
    def run(spark, sf):
        from framelake.plans.streams import stream_folder, windowed_events

        out = windowed_events(spark, sf, stream_folder(spark), kind)
        return out.select(*[c for c in ("video",) if c in out.columns], F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


_windowed("tumbling", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, count(*) AS n FROM events GROUP BY 1, 2 HAVING stop <= {_CLOSED}")
_windowed("sliding", f"SELECT start, start + INTERVAL 1 HOUR AS stop, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2 HAVING stop <= {_CLOSED}")
_windowed("session", f"""WITH g AS (SELECT user_id AS video, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT video, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY video, s HAVING stop <= {_CLOSED}""")
