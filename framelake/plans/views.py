"""The test tables as rasters, streams, benchmark pairs and manifests, for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

H, W = 32, 64
DEPTH_SCALE = 20000.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """video, frame, y, x, depth, r, g, b; a quarter of the grid is missing. Greatest values, so order can't change them."""
    t = table(spark, sf, "lineitem")
    keys = [F.col("l_returnflag").alias("video"), F.col("l_linenumber").alias("frame"), (F.col("l_orderkey") % H).cast("int").alias("y"), (F.col("l_partkey") % W).cast("int").alias("x")]
    return t.groupBy(*keys).agg(F.max("l_extendedprice").alias("depth"), F.max("l_quantity").alias("r"), F.max("l_discount").alias("g"), F.max("l_tax").alias("b"))


PX = f"px AS (SELECT l_returnflag AS video, l_linenumber AS frame, CAST(l_orderkey % {H} AS INTEGER) AS y, CAST(l_partkey % {W} AS INTEGER) AS x, max(l_extendedprice) AS depth, max(l_quantity) AS r, max(l_discount) AS g, max(l_tax) AS b FROM lineitem GROUP BY 1, 2, 3, 4)"
GRID = f"grid AS (SELECT f.video, f.frame, CAST(ys.range AS INTEGER) AS y, CAST(xs.range AS INTEGER) AS x FROM (SELECT DISTINCT video, frame FROM px) f, range({H}) ys, range({W}) xs)"
#: The dense raster: depth and colours 0 in holes.
DENSE = f"{GRID}, dense AS (SELECT g.video, g.frame, g.y, g.x, coalesce(p.depth, 0) AS depth, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b, p.r IS NULL AS hole FROM grid g LEFT JOIN px p USING (video, frame, y, x))"


def poses(spark: SparkSession, sf: str, right: float, ahead: float) -> DataFrame:
    """video, frame, pose, k: each frame's camera, turned about the vertical and moved along x and z; focal length 50 + frame along x."""
    angle = F.col("frame") * 0.03 + F.ascii("video") % 3 * 0.2
    c, s = F.cos(angle), F.sin(angle)
    row = F.array(c, F.lit(0.0), s, F.col("frame") * right, F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), -s, F.lit(0.0), c, F.col("frame") * ahead, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    k = F.array((F.col("frame") + 50).cast("double"), F.lit(50.0), F.lit(W / 2), F.lit(H / 2))
    return pixels(spark, sf).select("video", "frame").distinct().select("video", "frame", row.alias("pose"), k.alias("k"))


def frame_stream(spark: SparkSession, sf: str) -> DataFrame:
    """video, idx, value, type: each user's events in order."""
    t = table(spark, sf, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.select(F.col("user_id").alias("video"), (F.row_number().over(order) - 1).alias("idx"), "value", F.col("event_type").alias("type"))


FR = "fr AS (SELECT user_id AS video, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, value, event_type AS type FROM events)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """dataset, scene, frame, pixel, gt, pred_disp of an order: its price as depth, its lines' revenue as disparity."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.month("o_orderdate").alias("frame"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_regionkey").alias("dataset"), F.col("c_nationkey").alias("scene"), "frame", F.col("o_orderkey").alias("pixel"), (F.col("o_totalprice") / 10000.0).alias("gt"), (10000.0 / F.col("revenue")).alias("pred_disp"))
    )


PG = """pg AS (SELECT n_regionkey AS dataset, c_nationkey AS scene, CAST(month(o_orderdate) AS INTEGER) AS frame, o_orderkey AS pixel, o_totalprice / 10000.0::DOUBLE AS gt, 10000.0::DOUBLE / revenue AS pred_disp
  FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ok AS (SELECT * FROM pg WHERE gt > 0.001 AND gt < 80),
fit AS (SELECT dataset, scene, regr_slope(1 / (gt + 1e-8::DOUBLE), greatest(pred_disp, 0.001)) AS scale, regr_intercept(1 / (gt + 1e-8::DOUBLE), greatest(pred_disp, 0.001)) AS shift FROM ok GROUP BY 1, 2),
al AS (SELECT ok.*, least(greatest(1 / greatest(scale * greatest(pred_disp, 0.001) + shift, 0.001), 0.001), 80.0) AS pred FROM ok JOIN fit USING (dataset, scene))"""


def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """dataset, scene, frame, image, gt_depth, factor: suppliers of a nation as its frames."""
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf, "supplier").withColumn("frame", F.row_number().over(order) - 1)
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("dataset"), F.col("n_name").alias("scene"), "frame", F.concat("s_name", F.lit(".jpg")).alias("image"), F.concat("s_name", F.lit(".npy")).alias("gt_depth"), (F.col("s_suppkey") % 7 + 0.5).cast("double").alias("factor")
    )


MAN = """man AS (SELECT r_name AS dataset, n_name AS scene, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS frame, s_name || '.jpg' AS image, s_name || '.npy' AS gt_depth, CAST(s_suppkey % 7 + 0.5 AS DOUBLE) AS factor
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
