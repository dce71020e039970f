"""Benchmark manifests: nested JSON to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.schemas import MANIFEST, PAIRED_IMAGES


def flatten_manifest(json: DataFrame, column: str = "json") -> DataFrame:
    """dataset, scene, frame, image, gt_depth, factor, K, pose from manifest documents."""
    sets = json.select(F.explode(F.from_json(F.col(column), MANIFEST)).alias("dataset", "scenes"))
    scenes = sets.select("dataset", F.explode("scenes").alias("scene")).select("dataset", F.explode("scene").alias("scene", "entries"))
    return scenes.select("dataset", "scene", F.posexplode("entries").alias("frame", "e")).select("dataset", "scene", "frame", "e.*")


def build_manifest(rows: DataFrame) -> DataFrame:
    """dataset, json from rows (dataset, scene, frame, image, gt_depth, factor), entries in order of frame. A dataset's manifest is one document.

    Where rows have K and pose, arrays of rows, entries have them too.
    """
    fields = ["image", "gt_depth", "factor", *[c for c in ("K", "pose") if c in rows.columns]]
    entry = F.struct("frame", *fields)
    scenes = rows.groupBy("dataset", "scene").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    entries = F.transform("e", lambda e: F.struct(*[e[c].alias(c) for c in fields]))
    named = scenes.select("dataset", F.struct("scene", F.map_from_entries(F.array(F.struct(F.col("scene"), entries.alias("v")))).alias("m")).alias("s"))
    lists = named.groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("s.scene").alias("scene"), F.to_json("s.m").alias("j")))), lambda s: s["j"]).alias("l"))
    return lists.select("dataset", F.concat(F.lit('{"'), F.col("dataset"), F.lit('":['), F.array_join("l", ","), F.lit("]}")).alias("json"))


def flatten_pairs(json: DataFrame, column: str = "json") -> DataFrame:
    """split, image_id, image, target_image, ref_image, prompt of paired images; entries without image or target go."""
    splits = json.select(F.explode(F.from_json(F.col(column), PAIRED_IMAGES)).alias("split", "images"))
    return splits.select("split", F.explode("images").alias("image_id", "e")).select("split", "image_id", "e.*").filter("image IS NOT NULL AND target_image IS NOT NULL")


def positional_zip(left: DataFrame, right: DataFrame, keys: list[str], left_order: Column, right_order: Column, strict: bool = False) -> DataFrame:
    """Rows of both sides that have the same place in the order of their keys; ``strict`` raises where the lengths differ."""
    number = lambda df, order: df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    a, b = number(left, left_order), number(right, right_order)
    if not strict:
        return a.join(b, [*keys, "place"])
    names = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [*keys, "place"], "full")
    checked = F.assert_true(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both sides must be of equal length").isNull()
    return both.filter(checked).select(*keys, "place", *names[0], *names[1])


def existing(rows: DataFrame, files: DataFrame, on: str) -> DataFrame:
    """Rows whose file exists."""
    return rows.join(files.select(on), on, "left_semi")


def without(rows: DataFrame, excluded: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(excluded.select(*on), on, "left_anti")


# Depth limits, frames evaluated and crop of the benchmark datasets, and what divides raw depth.
DATASETS = {
    "kitti": (80.0, 0.1, 110, 0, 374, 0, 1242), "kitti_500": (80.0, 0.1, 500, 0, 374, 0, 1242), "sintel": (70.0, 0.1, 100, 0, 436, 0, 1024),
    "nyuv2_500": (10.0, 0.1, 500, 45, 471, 41, 601), "bonn": (10.0, 0.1, 110, 0, 480, 0, 640), "bonn_500": (10.0, 0.1, 500, 0, 480, 0, 640),
    "scannet": (10.0, 0.1, 90, 8, -8, 11, -11), "scannet_500": (10.0, 0.1, 500, 8, -8, 11, -11),
}
FACTORS = {"kitti": 256.0, "nyuv2": 6000.0, "bonn": 5000.0, "sintel": 65535.0 / 650.0, "scannet": 1000.0}
