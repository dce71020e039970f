"""Sinks: point clouds, result logs, raw frames in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ply(points: DataFrame, path: str) -> None:
    """An ASCII PLY of (x, y, z, r, g, b) below ``path``: a header file, and the vertices in part files that follow it."""
    n = points.count()
    kinds = [("double", c) for c in "xyz"] + [("uchar", c) for c in ("red", "green", "blue")]
    header = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property {k} {c}" for k, c in kinds], "end_header"]
    points.sparkSession.createDataFrame([(i, line) for i, line in enumerate(header)], "i int, value string").coalesce(1).orderBy("i").select("value").write.mode("overwrite").text(f"{path}/header")
    ply_lines(points).write.mode("overwrite").text(f"{path}/vertices")


def write_ply_files(points: DataFrame, path: str, key: str = "frame") -> None:
    """One whole ASCII PLY file below ``path``/<key>=... for each key of points, header first: what a PLY reader opens.

    A key's points, an image's at most, are one file and so one task; keys are
    written side by side. Vertices are ordered by their line.
    """
    kinds = [("double", c) for c in "xyz"] + [("uchar", c) for c in ("red", "green", "blue")]
    head = F.concat_ws("\n", F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), F.col("n").cast("string")), *[F.lit(f"property {k} {c}") for k, c in kinds], F.lit("end_header"))
    headers = points.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(0).alias("_part"), head.alias("value"))
    lines = headers.unionByName(ply_lines(points, key).select(key, F.lit(1).alias("_part"), "value"))
    lines.repartition(key).sortWithinPartitions(key, "_part", "value").select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def ply_lines(points: DataFrame, *keys: str) -> DataFrame:
    """keys, and value: a vertex line of each point (x, y, z, r, g, b)."""
    channel = lambda c: F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 255).cast("string")
    return points.select(*keys, F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"], *[channel(c) for c in "rgb"]).alias("value"))


def append_results(metrics: DataFrame, path: str) -> None:
    """One line ``key: value, ...`` per row, appended to a text log."""
    parts = [F.format_string(f"{c}: %s", F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in metrics.columns]
    metrics.select(F.concat_ws(", ", *parts).alias("value")).write.mode("append").text(path)


def clip_normalised(frames: DataFrame, value: str = "depth") -> DataFrame:
    """Add level, 0 to 255: value between the least and greatest of its whole clip; what a video encoder takes."""
    bounds = frames.groupBy("video").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return frames.join(bounds, "video").withColumn("level", F.floor(scaled * 255).cast("int")).drop("_lo", "_hi")


def write_frames(frames: DataFrame, path: str, key: str = "video", order: str = "frame") -> None:
    """Frames as parquet by video, in order inside each file."""
    frames.repartition(key).sortWithinPartitions(key, order).write.mode("overwrite").partitionBy(key).parquet(path)


class MissingEncoder(RuntimeError):
    """Video encoding and decoding need a codec, which is not part of this library."""


def encode_video(*_args, **_options) -> None:
    raise MissingEncoder("no video codec here; write_frames keeps the frames, in order, for an encoder")
