"""Binary raster formats to frame rows: .dpt, .pfm, .npy, .png, .exr."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.schemas import RASTERS
from framelake.sources.exr import read_depth_exr
from framelake.sources.png import read_png

#: First four bytes of a .dpt file, as a float.
DPT_TAG = 202021.25


def read_dpt(data: bytes) -> np.ndarray:
    if len(data) < 12 or np.frombuffer(data, "<f4", 1)[0] != np.float32(DPT_TAG):
        raise ValueError("not a depth file: wrong tag")
    w, h = np.frombuffer(data, "<i4", 2, 4)
    if not (0 < w < 100_000 and 0 < h < 100_000 and 1 < w * h < 100_000_000):
        raise ValueError(f"not a depth file: size {w} x {h}")
    return np.frombuffer(data, "<f4", w * h, 12).reshape(h, w)


def read_pfm(data: bytes) -> np.ndarray:
    """Rows from the top; the sign of the scale tells the byte order."""
    stream = io.BytesIO(data)
    kind = stream.readline().strip()
    if kind not in (b"PF", b"Pf"):
        raise ValueError("not a PFM file")
    size = stream.readline().split()
    if len(size) != 2:
        raise ValueError("malformed PFM header")
    w, h = map(int, size)
    order = "<" if float(stream.readline()) < 0 else ">"
    values = np.frombuffer(stream.read(), f"{order}f4").reshape((h, w, 3) if kind == b"PF" else (h, w))
    return np.flipud(values)


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False).astype(np.float32)


READERS = {"dpt": read_dpt, "pfm": read_pfm, "npy": read_npy, "png": read_png, "exr": read_depth_exr}


def decode(data: bytes, path: str) -> tuple[int, int, int, np.ndarray]:
    image = READERS[path.rsplit(".", 1)[-1].lower()](data)
    h, w = image.shape[:2]
    return h, w, image.size // (h * w), np.ascontiguousarray(image, dtype=np.float32).ravel()


def read_rasters(spark: SparkSession, path: str, pattern: str = "*.{dpt,pfm,npy,png,exr}") -> DataFrame:
    """path, h, w, channels, values of each raster file below a folder. A malformed file raises."""
    return decode_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path))


def decode_files(files: DataFrame) -> DataFrame:
    """path, h, w, channels, values of rows (path, content), by the path's suffix; one raster is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *decode(bytes(content), path))], columns=RASTERS.names)

    return files.select("path", "content").mapInPandas(run, RASTERS)


def to_pixels(frames: DataFrame, value: str = "values", out: str = "depth") -> DataFrame:
    """A row per pixel of single-channel frames."""
    others = [c for c in frames.columns if c not in ("h", "w", "channels", value)]
    return frames.select(*others, "w", F.posexplode(value).alias("_i", "_v")).select(*others, F.floor(F.col("_i") / F.col("w")).cast("int").alias("y"), (F.col("_i") % F.col("w")).cast("int").alias("x"), F.col("_v").cast("double").alias(out))


def to_frames(px: DataFrame, keys: list[str], w: int, value: str = "depth") -> DataFrame:
    """keys, values: a frame's pixels in row-major order."""
    ordered = F.array_sort(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("i"), F.col(value).alias("v"))))
    return px.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias("values"))


def camera_arrays(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """path, name, shape, values: every numeric array of the .npz files below ``path``, by row. Files are read in their tasks, never on the driver."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content)) as arrays:
                    rows += [(name, k, list(arrays[k].shape), arrays[k].astype(float).ravel()) for k in arrays.files if arrays[k].dtype.kind in "biuf"]
            yield pd.DataFrame(rows, columns=["path", "name", "shape", "values"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(read, "path string, name string, shape array<int>, values array<double>")
