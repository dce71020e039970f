"""Temporal operators over ordered frames: smoothing, inference windows, caches, taps, slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import even_up

#: Frames in an inference window, frames it shares with the next one, frames of a cross-fade, frames a cache holds.
WINDOW, OVERLAP, FADE, CACHE = 32, 10, 8, 31
STEP = WINDOW - OVERLAP


def with_index(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Add idx, the place of a row in its key's order, from 0."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


#: Values of idx in a block of a recursion that is cut into blocks.
BLOCK = 4096


def _entering(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The smoothed value that enters each block, of blocks in the order of their keys."""
    last, x = NO_KEY, 0.0
    for batch in batches:
        out = []
        for k, first, factor, offset in zip(_keys(batch["_key"]), batch["first"], batch["factor"], batch["offset"], strict=True):
            x, last = first if k != last else x, k
            out.append(x)
            x = factor * x + offset
        yield pd.DataFrame({"_of": batch["_key"], "_block": batch["block"], "enters": out})


#: Frames that are smoothed together.
_FRAMES = 1 << 18


def _finished(a: float, names: list[str]):
    """The smoothed frames of blocks (key, idx, v, enters), a step for all blocks of a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())
            cuts = np.unique([0, *np.searchsorted(ends, np.arange(_FRAMES, ends[-1] if len(ends) else 0, _FRAMES)), len(ends)])
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                key, idx, v, enters = batch.slice(low, high - low).columns
                n = pc.list_value_length(v).to_numpy()
                values, x = v.flatten().to_numpy(zero_copy_only=False), enters.to_numpy(zero_copy_only=False).astype(float)
                # Longest first, so that the blocks that go on are those up to some place.
                order = np.argsort(-n, kind="stable")
                at, x, live = (np.cumsum(n) - n)[order], x[order], np.searchsorted(-n[order], -np.arange(n.max(initial=0)))
                out = np.empty(len(values))
                for step, count in enumerate(live):
                    x = a * values[at[:count] + step] + (1 - a) * x[:count]
                    out[at[:count] + step] = x
                yield pa.RecordBatch.from_arrays([key.take(pa.array(np.repeat(np.arange(len(n)), n))), idx.flatten(), pa.array(out, from_pandas=True)], names=names)

    return run


def ema(rows: DataFrame, a: float, key: str = "video", value: str = "value", block: int = BLOCK) -> DataFrame:
    """key, idx, smoothed: a * current + (1 - a) * smoothed before; the first passes, a = 0 leaves all as it is.

    A prefix scan, so that one key's frames spread over all tasks: what a block
    of ``block`` values of idx makes of the value that enters it is linear, so each block
    is folded to (factor, offset); these, one row per block, are combined in
    order, and each block then starts from the value that enters it. Frames are taken by
    idx, which may have gaps but no ties. A null key is a key.
    """
    values = F.col(value).cast("double")
    if a == 0:
        return rows.select(key, "idx", values.alias("smoothed"))
    name = rows.schema[key].dataType.simpleString()
    given = rows.select(F.col(key).alias("_key"), F.col("idx").cast("long").alias("idx"), values.alias("v"))
    blocks = given.groupBy("_key", F.floor(F.col("idx") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("row"))
    fold = F.aggregate("row", F.lit(0.0), lambda acc, r: acc * (1 - a) + r["v"] * a)
    facts = blocks.select("_key", "block", F.pow(F.lit(1.0 - a), F.size("row")).alias("factor"), fold.alias("offset"), F.col("row")[0]["v"].alias("first"))
    ordered = facts.repartition("_key").sortWithinPartitions("_key", "block")
    entering = ordered.mapInPandas(_entering, f"_of {name}, _block long, enters double")
    met = blocks.join(entering, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_block")))
    each = met.select("_key", F.col("row.idx").alias("idx"), F.col("row.v").alias("v"), "enters")
    return each.mapInArrow(_finished(a, [key, "idx", "smoothed"]), f"{key} {name}, idx long, smoothed double")


def _in_order(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """A key's rows together in one partition, in the order of idx, for what carries state from row to row."""
    return rows.select(key, F.col("idx").cast("long").alias("idx"), *columns).repartition(key).sortWithinPartitions(key, "idx")


def _keys(column: pd.Series) -> list:
    """A batch's keys, a null one as None whatever pandas makes of it, so that it equals itself."""
    return [None if pd.isna(k) else k for k in column]


#: No row's key, for the row before a task's first one.
NO_KEY = object()


def ema_long(rows: DataFrame, a: float, key: str = "video", value: str = "value") -> DataFrame:
    """The same in order: a key's frames pass one task in Arrow batches, with only a running value between them."""

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, prev = NO_KEY, 0.0
        for batch in batches:
            out = []
            for k, v in zip(_keys(batch[key]), batch["v"], strict=True):
                prev = v if k != last or a == 0 else a * v + (1 - a) * prev
                last = k
                out.append(prev)
            yield pd.DataFrame({key: batch[key], "idx": batch["idx"], "smoothed": out})

    ready = _in_order(rows.withColumn("v", F.col(value).cast("double")), key, "v")
    return ready.mapInPandas(smooth, f"{key} {ready.schema[key].dataType.simpleString()}, idx long, smoothed double")


#: Parts of a pixel that sampling positions are rounded to, half to even.
SUBPIXELS = 32


def sampled_along(depth: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear samples of (h, w) ``depth`` at each pixel's place plus its flow, and whether that place is strictly inside."""
    h, w = depth.shape
    fx, fy = np.arange(w)[None, :] + dx, np.arange(h)[:, None] + dy
    inside = (fx > 0) & (fx < w - 1) & (fy > 0) & (fy < h - 1)
    qx, qy = (np.rint(np.where(inside, f, 0) * SUBPIXELS).astype(np.int64) for f in (fx, fy))
    x0, y0, ax, ay = qx // SUBPIXELS, qy // SUBPIXELS, qx % SUBPIXELS / SUBPIXELS, qy % SUBPIXELS / SUBPIXELS
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    top, low = depth[y0, x0] * (1 - ax) + depth[y0, x1] * ax, depth[y1, x0] * (1 - ax) + depth[y1, x1] * ax
    return top * (1 - ay) + low * ay, inside


def smooth_along_flow(frames: DataFrame, a: float, h: int, w: int, key: str = "video") -> DataFrame:
    """key, idx, depth: each frame's depth blended with the smoothed depth before it, sampled along the flow.

    ``frames`` has a row per frame: depth, dx and dy, arrays of h * w values by
    row. The depth before is what this operator returned for that frame; where
    the flow leaves the frame's inside, and in a key's first frame, depth stays.
    A key's frames pass one task in order, and one frame is held between them.
    """

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, before = NO_KEY, None
        for batch in batches:
            out = []
            for k, depth, dx, dy in zip(_keys(batch[key]), batch["depth"], batch["dx"], batch["dy"], strict=True):
                now = np.asarray(depth, dtype=float).reshape(h, w)
                if before is not None and k == last:
                    past, inside = sampled_along(before, np.asarray(dx, dtype=float).reshape(h, w), np.asarray(dy, dtype=float).reshape(h, w))
                    now = np.where(inside, a * now + (1 - a) * past, now)
                last, before = k, now
                out.append(now.ravel())
            yield pd.DataFrame({key: batch[key], "idx": batch["idx"], "depth": out})

    ready = _in_order(frames, key, "depth", "dx", "dy")
    return ready.mapInPandas(smooth, f"{key} {ready.schema[key].dataType.simpleString()}, idx long, depth array<double>")


def as_frames(grid: DataFrame, values: tuple[str, ...], key: str = "video") -> DataFrame:
    """key, idx and an array per value, by row, of each frame of a dense grid."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", *values)))
    return grid.groupBy(key, F.col("frame").alias("idx")).agg(cells.alias("_c")).select(key, "idx", *[F.col("_c").getField(v).alias(v) for v in values])


def as_pixels(frames: DataFrame, value: str, w: int, key: str = "video") -> DataFrame:
    """key, frame, y, x, value: the other way round."""
    each = frames.select(key, F.col("idx").cast("int").alias("frame"), F.posexplode(value).alias("_p", value))
    return each.select(key, "frame", F.floor(F.col("_p") / w).cast("int").alias("y"), (F.col("_p") % w).cast("int").alias("x"), value)


def windows(lengths: DataFrame, key: str = "video", length: str = "n") -> DataFrame:
    """key, window, slot, frame: the frames of each inference window, its first slots taken over from the window before.

    Slot 0 of a later window is frame 0, slot 1 the frame 10 before the window's
    start; the last frame pads the tail.
    """
    each = lengths.withColumn("window", F.explode(F.sequence(F.lit(0), (F.ceil(F.col(length) / STEP) - 1).cast("int")))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))))
    plain = F.least(F.col("window") * STEP + F.col("slot"), F.col(length) - 1)
    later = F.col("window") > 0
    frame = F.when(later & (F.col("slot") == 0), F.lit(0)).when(later & (F.col("slot") == 1), F.col("window") * STEP - OVERLAP).otherwise(plain)
    return each.select(key, "window", "slot", frame.cast("int").alias("frame"))


def cache_slots(lengths: DataFrame, key: str = "video", length: str = "n") -> DataFrame:
    """key, t, slot, frame: the frames that frame t of a stream attends to besides itself, from t = 1 on."""
    each = lengths.filter(F.col(length) > 1).withColumn("t", F.explode(F.sequence(F.lit(1), (F.col(length) - 1).cast("int")))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(CACHE - 1))))
    back = F.when(F.col("slot") == 0, F.col("t")).when(F.col("slot") == 1, F.lit(41)).otherwise(F.lit(CACHE) - F.col("slot"))
    return each.select(key, "t", "slot", F.greatest(F.col("t") - back, F.lit(0)).cast("int").alias("frame"))


def tap_pool(rows: DataFrame, taps: tuple[int, ...] = (-5, -1, 0, 1, 5), key: str = "video", value: str = "value") -> DataFrame:
    """Add tap_0 ...: the value ``taps`` frames away, the first or last one beyond the ends."""
    order = Window.partitionBy(key).orderBy("idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for i, t in enumerate(taps):
        end = F.first(value).over(whole) if t < 0 else F.last(value).over(whole)
        rows = rows.withColumn(f"tap_{i}", F.col(value) if t == 0 else F.coalesce(F.lag(value, -t).over(order) if t < 0 else F.lead(value, t).over(order), end))
    return rows


def recurrent_pool(rows: DataFrame, step: Callable[[np.ndarray], float], taps: tuple[int, ...] = (-5, -1, 0, 1, 5), key: str = "video", value: str = "value") -> DataFrame:
    """key, idx, out: ``step`` of the taps of each frame and, in third place, of what it gave for the frame before.

    In a key's first frame that is the frame itself. A key's frames pass one task
    in order, a batch at a time, with one output held between them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, before = NO_KEY, None
        for batch in batches:
            pool, out = batch[[f"tap_{i}" for i in range(len(taps))]].to_numpy(dtype=float), []
            for k, now, own in zip(_keys(batch[key]), pool, batch[value], strict=True):
                before = step(np.insert(now, 2, before if before is not None and k == last else own))
                last = k
                out.append(before)
            yield pd.DataFrame({key: batch[key], "idx": batch["idx"], "out": out})

    ready = _in_order(tap_pool(rows, taps, key, value), key, value, *[f"tap_{i}" for i in range(len(taps))])
    return ready.mapInPandas(run, f"{key} {ready.schema[key].dataType.simpleString()}, idx long, out double")


def slice_frames(rows: DataFrame, start: int, stop: int, step: int) -> DataFrame:
    return rows.filter((F.col("idx") >= start) & (F.col("idx") < stop) & ((F.col("idx") - start) % step == 0))


def whole_chunks(rows: DataFrame, size: int, key: str = "video") -> DataFrame:
    """Add chunk; frames beyond the last whole chunk go."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    chunk = F.floor(F.col("idx") / size).cast("int")
    return rows.join(counts, key).withColumn("chunk", chunk).filter((F.col("chunk") + 1) * size <= F.col("_n")).drop("_n")


def sampled(rows: DataFrame, fps: Column, target_fps: float, most: int, backend: str) -> DataFrame:
    """Frames at a stride of max(rint(fps / target), 1): ``decord`` caps the frames it keeps, ``cv2`` those it reads."""
    stride = F.greatest(F.rint(F.when(fps > 0, fps).otherwise(30.0) / target_fps).cast("int"), F.lit(1))
    kept = rows.withColumn("stride", stride).filter(F.col("idx") % F.col("stride") == 0)
    return kept.filter(F.col("idx") / F.col("stride") < most) if backend == "decord" else kept.filter(F.col("idx") < most)


def sampled_size(h: Column, w: Column, most: int, backend: str) -> tuple[Column, Column]:
    """Frame size with its longer edge at most ``most``; decord's dimensions are rounded up to even ones."""
    scale = F.when(F.greatest(h, w) > most, F.lit(float(most)) / F.greatest(h, w)).otherwise(1.0)
    out = [F.rint(v * scale).cast("int") for v in (h, w)]
    return tuple(even_up(v) for v in out) if backend == "decord" else tuple(out)


def cross_fade(overlap: DataFrame) -> DataFrame:
    """Add faded from before, after and j: weights j / 7 over the 8 frames of an overlap."""
    weight = F.col("j") / float(FADE - 1)
    return overlap.withColumn("faded", F.col("before") * (1 - weight) + F.col("after") * weight)


def fit_scale_shift(p: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    pp, sp, n, pt, st = float(p @ p), float(p.sum()), float(len(p)), float(p @ t), float(t.sum())
    det = pp * n - sp * sp
    return ((n * pt - sp * st) / det, (-sp * pt + pp * st) / det) if det else (1.0, 0.0)


def alignment_chain(predicted: np.ndarray, length: int | None = None, metric: bool = False) -> np.ndarray:
    """Aligned depth of a clip from its windows' predictions, (windows, 32, ...), in the first window's scale.

    Every later window is fitted by its slots 0 and 1 to the first window's frame
    0, as it was predicted, and to slot 12 of the window before, aligned; it is
    cut at 0 and faded in over the overlap. ``length`` frames stay: windows pad
    the tail. ``metric`` depth has a scale already and is only cut and faded.
    """
    out = [f for f in predicted[0]]
    first, shared = predicted[0][0], predicted[0][12]
    for window in predicted[1:]:
        scale, shift = (1.0, 0.0) if metric else fit_scale_shift(window[:2].ravel(), np.concatenate([first.ravel(), shared.ravel()]))
        aligned = np.maximum(window * scale + shift, 0)
        for j in range(FADE):
            weight = j / (FADE - 1)
            out[-FADE + j] = out[-FADE + j] * (1 - weight) + aligned[OVERLAP - FADE + j] * weight
        out += [f for f in aligned[OVERLAP:]]
        shared = aligned[12]
    return np.array(out[:length])


def align_windows(rows: DataFrame, key: str = "video", metric: bool = False) -> DataFrame:
    """key, frame, value from rows (key, window, slot, frame, value): alignment_chain for each key, a clip of scalars.

    One row comes back for each frame. A clip is sequential by nature, so it is
    one group; clips run side by side.
    """

    def chain(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip.sort_values(["window", "slot"])
        values = alignment_chain(clip["value"].to_numpy(dtype=float).reshape(-1, WINDOW, 1), int(clip["frame"].max()) + 1, metric)[:, 0]
        return pd.DataFrame({key: clip[key].iloc[0], "frame": np.arange(len(values)), "value": values})

    return rows.groupBy(key).applyInPandas(chain, f"{key} {rows.schema[key].dataType.simpleString()}, frame long, value double")


def stage_report(rows: DataFrame, stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """stage, seconds, share of the total."""
    sums = rows.groupBy(stage).agg(F.sum(seconds).alias("seconds"))
    total = sums.agg(F.sum("seconds").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select(stage, "seconds", F.try_divide(F.col("seconds"), F.col("total")).alias("share"))


def nested_stage_report(rows: DataFrame, frames: int, stage: str = "stage", parent: str = "parent", seconds: str = "seconds") -> DataFrame:
    """stage, parent, seconds, share of the parent's seconds (of all stages without a parent where it has none), fps: ``frames`` per second of a stage.

    Shares are 0 where the whole is; a stage shorter than a microsecond counts as one long.
    """
    sums = rows.groupBy(stage, parent).agg(F.sum(seconds).alias("seconds"))
    tops = sums.filter(F.col(parent).isNull()).agg(F.sum("seconds").alias("_whole")).select(F.lit(None).cast("string").alias("_of"), "_whole")
    # A row per stage, as many as a program has names for.
    wholes = rows.groupBy(F.col(stage).alias("_of")).agg(F.sum(seconds).alias("_whole")).unionByName(tops)
    met = sums.join(wholes, F.col(parent).eqNullSafe(F.col("_of")), "left")
    share = F.when(F.col("_whole") > 0, F.col("seconds") / F.col("_whole")).otherwise(0.0)
    return met.select(stage, parent, "seconds", share.alias("share"), (frames / F.greatest("seconds", F.lit(1e-6))).alias("fps"))


def best_so_far(rows: DataFrame, value: str, best: str, key: str = "video") -> DataFrame:
    """Add best: the running ``max`` or ``min``."""
    order = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("best", (F.max if best == "max" else F.min)(value).over(order))


def dyadic_differences(rows: DataFrame, strides: tuple[int, ...] = (1, 2, 4), key: str = "video", value: str = "value") -> DataFrame:
    """key, stride, idx, step: difference to the frame before, among every stride-th frame."""
    each = rows.withColumn("stride", F.explode(F.array(*[F.lit(s) for s in strides]))).filter(F.col("idx") % F.col("stride") == 0)
    order = Window.partitionBy(key, "stride").orderBy("idx")
    return each.select(key, "stride", "idx", (F.col(value) - F.lag(value).over(order)).alias("step")).filter("step IS NOT NULL")


def running_mean(rows: DataFrame, key: str = "video", value: str = "value") -> DataFrame:
    """Add mean: over the key's frames so far."""
    order = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mean", F.avg(value).over(order))


def next_frames(rows: DataFrame, keys: list[str], item: str, order: str = "frame") -> DataFrame:
    """keys, order, item, next_item for each frame that has one after it."""
    follows = Window.partitionBy(*keys).orderBy(order)
    return rows.select(*keys, order, item, F.lead(item).over(follows).alias(f"next_{item}")).filter(F.col(f"next_{item}").isNotNull())


def sampled_views(rows: DataFrame, keys: list[str], item: str, n: int, seed: str = "views") -> DataFrame:
    """``n`` views of each sample without replacement, drawn by the sample's keys and the item, so the same ones in every run."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), *keys, item).cast("binary"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(draw, item))).filter(F.col("_r") <= n).drop("_r")
