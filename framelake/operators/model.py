"""Depth models as plug-ins: any object with predict(h, w, image) -> depth runs over frame rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class DepthModel(Protocol):
    def predict(self, h: int, w: int, image: np.ndarray) -> np.ndarray:
        """Depth (h, w) of an image (h, w, 3), blue first, 0 to 255."""


class Luminance:
    """Stand-in without weights: depth is the image's luminance in [0, 1]."""

    def predict(self, h: int, w: int, image: np.ndarray) -> np.ndarray:
        return (image @ np.array([0.114, 0.587, 0.299])) / 255.0


def infer_depth(frames: DataFrame, model: DepthModel, micro_batch: int = 4) -> DataFrame:
    """video, frame, h, w, values from frames with a binary column image.

    A model that has predict_batch(h, w, images) gets up to ``micro_batch``
    neighbouring frames of one size at once, which bounds what it holds; others
    get them one by one. The depth of a frame is the same either way.
    """

    def predicted(h: int, w: int, images: list[np.ndarray]) -> list[np.ndarray]:
        return list(model.predict_batch(h, w, np.stack(images))) if hasattr(model, "predict_batch") else [model.predict(h, w, i) for i in images]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for (h, w), of_size in groupby(batch.itertuples(), key=lambda r: (r.h, r.w)):
                while part := list(islice(of_size, micro_batch)):
                    depth = predicted(h, w, [np.frombuffer(r.image, dtype=np.uint8).reshape(h, w, 3) for r in part])
                    rows += [(r.video, r.frame, h, w, d.astype(np.float32).ravel()) for r, d in zip(part, depth, strict=True)]
            yield pd.DataFrame(rows, columns=["video", "frame", "h", "w", "values"])

    return frames.select("video", "frame", "h", "w", "image").mapInPandas(run, "video string, frame long, h int, w int, values array<float>")
