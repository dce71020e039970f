"""Depth as benchmarks store it: scans of predicted and of true depth, and images made of depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.schemas import RASTERS
from framelake.sources.manifest import DATASETS, FACTORS
from framelake.sources.png import read_png, write_png
from framelake.sources.rasters import READERS

#: 14-bit weights of red, green and blue in an 8-bit gray image.
GRAY_BITS, RED, GREEN, BLUE = 14, 4899, 9617, 1868
#: (first row, row after the last, first column, column after the last)
Crop = tuple[int, int, int, int]


def gray8(image: np.ndarray) -> np.ndarray:
    """An image as 8-bit gray: 16 bits lose their lower byte, alpha is left out."""
    if image.dtype == np.uint16:
        image = (image >> 8).astype(np.uint8)
    if image.ndim == 2 or image.shape[2] <= 2:
        return image if image.ndim == 2 else image[..., 0]
    r, g, b = (image[..., i].astype(np.int64) for i in range(3))
    return ((r * RED + g * GREEN + b * BLUE + (1 << GRAY_BITS - 1)) >> GRAY_BITS).astype(np.uint8)


def resized(values: np.ndarray, h: int, w: int) -> np.ndarray:
    """h x w values between the four nearest ones, middles of pixels on middles, edges repeated."""

    def places(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, source - 1), at - low

    y0, y1, fy = places(values.shape[0], h)
    x0, x1, fx = places(values.shape[1], w)
    rows = values[y0] * (1 - fy)[:, None] + values[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def _each(files: DataFrame, of) -> DataFrame:
    """RASTERS rows of ``of(path, content, further)``, one file at a time; further is the rest of the row."""
    given = files.select("path", "content", F.struct(*[F.col(c) for c in files.columns if c != "content"]).alias("_row"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, row in zip(batch["path"], batch["content"], batch["_row"], strict=True):
                image = of(path, bytes(content), row)
                yield pd.DataFrame([(path, *image.shape, 1, image.astype(np.float32).ravel())], columns=RASTERS.names)

    return given.mapInPandas(run, RASTERS)


def _kind(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def predicted_depth(files: DataFrame, crop: Crop | None = None) -> DataFrame:
    """path, h, w, channels, values of predicted depth.

    ``files`` has path and content, as Spark's binaryFile gives them; with columns
    target_h and target_w too, maps are resized to that where they differ, after
    ``crop``. Arrays keep their values; images are taken as 8-bit gray and multiplied by 255,
    the inverse of the factor that benchmarks divide by.
    """

    def read(path: str, content: bytes, row) -> np.ndarray:
        values = gray8(read_png(content)).astype(np.float32) * 255 if _kind(path) == "png" else READERS[_kind(path)](content)
        if crop:
            values = values[crop[0] : crop[1], crop[2] : crop[3]]
        size = (row.get("target_h"), row.get("target_w"))
        return values if None in size or values.shape == size else resized(values, *size)

    return _each(files, read)


def true_depth(files: DataFrame, unknown: float | None = -1.0, factor: str = "factor") -> DataFrame:
    """path, h, w, channels, values of true depth: what the file holds at its own bit depth, over its ``factor``.

    ``files`` has path, content and the factor column. 0 means that depth is unknown and becomes ``unknown``:
    -1 where valid depth is told by its sign, 0 to leave it; null in ``known_depth``.
    """

    def read(path: str, content: bytes, row) -> np.ndarray:
        values = (read_png(content) if _kind(path) == "png" else READERS[_kind(path)](content)).astype(np.float64) / row[factor]
        return values if unknown is None else np.where(values == 0, unknown, values)

    return _each(files, read)


def dataset_factor(dataset: Column) -> Column:
    """What divides raw depth of a benchmark dataset, by its name without what follows an underscore; null for others."""
    table = F.create_map(*[F.lit(x) for pair in FACTORS.items() for x in pair])
    return table[F.substring_index(dataset, "_", 1)]


def dataset_crop(dataset: str) -> Crop:
    """The part of a benchmark dataset's depth maps that is evaluated; negative ends count from the far edge."""
    return DATASETS[dataset][3:]


def known_depth(values: Column, unknown: float = -1.0) -> Column:
    """An array of depth with null in place of unknown values."""
    return F.transform(values, lambda v: F.nullif(v, F.lit(float(unknown)).cast("float")))


def cropped(rasters: DataFrame, crop: Crop) -> DataFrame:
    """RASTERS rows cut to ``crop``, which is kept within each one; the folder sink then writes the copies."""
    top, left = F.lit(crop[0]), F.lit(crop[2])
    h = F.greatest(F.least(F.lit(crop[1]), "h") - top, F.lit(0))
    w = F.greatest(F.least(F.lit(crop[3]), "w") - left, F.lit(0))
    row = lambda y: F.slice("values", (y * F.col("w") + left) * F.col("channels") + 1, F.col("_w") * F.col("channels"))
    rows = F.flatten(F.transform(F.sequence(top, top + F.col("_h") - 1), row))
    others = [c for c in rasters.columns if c not in ("h", "w", "values")]
    cut = rasters.withColumn("_h", h).withColumn("_w", w).filter("_h > 0 AND _w > 0").withColumn("values", rows)
    return cut.select(*others, F.col("_h").alias("h"), F.col("_w").alias("w"), "values").select(*rasters.columns)


def png_images(frames: DataFrame, bits: int = 8) -> DataFrame:
    """Add content: each frame's values (h, w, channels, values) as a PNG.

    8 bits: values are cut off at the point, within 0 to 255. 16 bits: cut off
    likewise and taken modulo 65,536, as raw depth is kept by tools that
    write it so; null and not-a-number are 0.
    """
    if bits not in (8, 16):
        raise ValueError("a PNG has 8 or 16 bits here")
    kept = [c for c in frames.columns if c != "values"]
    out = frames.select(*kept).schema.add("content", "binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = []
            for h, w, channels, values in zip(batch["h"], batch["w"], batch["channels"], batch["values"], strict=True):
                flat = np.nan_to_num(np.trunc(np.asarray(values, dtype=np.float64)), nan=0.0)
                whole = np.clip(flat, 0, 255).astype(np.uint8) if bits == 8 else (flat.astype(np.int64) & 0xFFFF).astype(np.uint16)
                content.append(write_png(whole.reshape((h, w) if channels == 1 else (h, w, channels))))
            yield batch[kept].assign(content=content)

    return frames.select(*kept, "values").mapInPandas(run, out)
