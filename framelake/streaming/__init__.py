"""Streams of frames: state per video, bounded input per trigger, windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.streaming.ordered import attended_stream, hidden_state_stream, smooth_stream, window_stream

__all__ = ["attended_stream", "event_windows", "frame_stream", "hidden_state_stream", "run_once", "smooth_stream", "window_stream"]


def frame_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Files as a stream, a bounded number of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_windows(events: DataFrame, kind: str, lateness: str = "10 minutes", length: str = "1 hour", slide: str = "30 minutes", gap: str = "30 minutes") -> DataFrame:
    """start, stop, n of ``tumbling``, ``sliding`` or ``session`` windows over column ts, late rows up to ``lateness``."""
    window = {"tumbling": lambda: F.window("ts", length), "sliding": lambda: F.window("ts", length, slide), "session": lambda: F.session_window("ts", gap)}[kind]()
    keys = [window.alias("w"), *(["video"] if kind == "session" else [])]
    counted = events.withWatermark("ts", lateness).groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.select(*(["video"] if kind == "session" else []), F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, then stop: files written exactly once under ``path``."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
