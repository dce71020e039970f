"""The events table as a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans.views import frame_stream, table
from framelake.streaming import attended_stream, event_windows, hidden_state_stream, run_once, smooth_stream, window_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of this machine only where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream-")


def replayed(spark: SparkSession, rows: DataFrame, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """``rows`` written as files and read as a stream."""
    rows.write.mode("overwrite").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/in")


def smoothed_events(spark: SparkSession, sf: str, folder: str, a: float = 0.75) -> DataFrame:
    """video, idx, smoothed: the last smoothed value of each video.

    A video's frames lie in one file, in order, so they reach its state in order.
    """
    folder = f"{folder}/{uuid.uuid4()}"
    rows = frame_stream(spark, sf).select(F.col("video").cast("long").alias("video"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    stream = replayed(spark, rows.repartition("video").sortWithinPartitions("video", "idx"), folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    run_once(smooth_stream(stream, a), f"{folder}/out", f"{folder}/state")
    last = F.max(F.struct("idx", "smoothed")).alias("last")
    return spark.read.parquet(f"{folder}/out").groupBy("video").agg(last).select("video", "last.idx", "last.smoothed")


def attended_events(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """video, idx, attended: the frames that each frame of the stream attends to."""
    folder = f"{folder}/{uuid.uuid4()}"
    rows = frame_stream(spark, sf).select(F.col("video").cast("long").alias("video"), F.col("idx").cast("long").alias("idx"))
    stream = replayed(spark, rows.repartition("video").sortWithinPartitions("video", "idx"), folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    run_once(attended_stream(stream), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """video, idx, ts, vector: each user's events in order, the value as a vector."""
    frames = frame_stream(spark, sf).select(F.col("video").cast("long").alias("video"), F.col("idx").cast("long").alias("idx"), F.array(F.col("value").cast("double")).alias("vector"))
    return frames.withColumn("ts", F.timestamp_seconds(F.lit(1_577_836_800) + F.col("idx") * 60))


def _mean_attended(vector, cache):
    """Half the frame, half the mean of what it attends to; the frame itself is what later ones see of it."""
    return (vector + cache.mean(axis=0)) / 2 if len(cache) else vector, vector


def remembered_events(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """video, idx, out: each frame with the mean of the hidden states that its ring holds, frames in shuffled files."""
    folder = f"{folder}/{uuid.uuid4()}"
    stream = replayed(spark, _vectors(spark, sf).select("video", "idx", "vector").repartition(6, F.xxhash64("video", "idx")), folder, 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    run_once(hidden_state_stream(stream, _mean_attended), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("video", "idx", F.col("out")[0].alias("out"))


def count_windows_of_events(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """video, window, slot, frame, value: windows of 32 frames from frames in shuffled files.

    Frames are a minute apart; the row after all others, of video -1, moves the
    watermark on, so that every video's timer pads its tail. Frames come late by up to the whole length of the longest video.
    """
    folder = f"{folder}/{uuid.uuid4()}"
    rows = _vectors(spark, sf)
    rows.repartition(6, F.xxhash64("video", "idx")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for _ in range(2):
        run_once(window_stream(stream, "1 hour", "3650 days"), f"{folder}/out", f"{folder}/state")
        end = spark.sql("SELECT -1L AS video, 0L AS idx, array(0.0D) AS vector, timestamp_seconds(1577836800L + 20 * 365 * 86400L) AS ts")
        end.write.mode("append").parquet(f"{folder}/in")
    out = spark.read.parquet(f"{folder}/out").filter("video >= 0")
    return out.select("video", "window", "slot", "frame", F.col("vector")[0].alias("value"))


def windowed_events(spark: SparkSession, sf: str, folder: str, kind: str) -> DataFrame:
    """Closed event-time windows of the events, by the stream."""
    folder = f"{folder}/{uuid.uuid4()}"
    rows = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("video"), F.col("ts").cast("timestamp").alias("ts"))
    run_once(event_windows(replayed(spark, rows, folder), kind), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")
