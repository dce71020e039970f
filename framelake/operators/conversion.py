"""The whole way from pixels with depth to a stereo image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import quantise
from framelake.operators import frames as fr


def right_view(
    px: DataFrame, h: int, w: int, mode: str = "inverse", low: float = 0.01, high: float = 0.99, max_disparity: float = 16.0,
    dilate: int = 0, kernel: int = 7, fill: str = "compat", rounds: int = 1,
) -> DataFrame:
    """video, frame, y, x, r, g, b of the right eye, every cell of the frame.

    Depth is normalised between its quantiles, becomes disparity by ``mode``,
    pixels move and the nearest wins; holes spread ``dilate`` columns to the left
    and take the mean of what their box knows.
    """
    moved = fr.near_and_disparity(fr.quantile_normalise(px, low=low, high=high), mode, max_disparity)
    grid = fr.with_holes(fr.zbuffer_packed(moved, h, w), h, w)
    if dilate:
        grid = fr.dilate_left(grid, dilate, w)
    return fr.box_inpaint(grid, kernel, mode=fill, rounds=rounds).select(*fr.FRAME, "y", "x", "r", "g", "b")


def to_stereo(px: DataFrame, h: int, w: int, layout: str = "sbs", alpha: float = 0.5, levels: int | None = 255, **options) -> DataFrame:
    """Both eyes in one ``layout``, channels of [0, 1] as 0 to ``levels`` (None: as they are).

    ``px`` has video, frame, y, x, depth and r, g, b in [0, 1]; ``options`` are right_view's.
    """
    out = fr.compose_stereo(px, right_view(px, h, w, **options), layout, h, w, alpha)
    return out if levels is None else out.withColumns({c: quantise(F.col(c), levels) for c in "rgb"})
