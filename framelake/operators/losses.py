"""Composite losses, built from the reductions in evaluation.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import evaluation as ev

CLIP_FRAME = ("video", "frame")


def silog_loss(px: DataFrame, balance: float = 0.5, keys: tuple[str, ...] = ev.SCENE) -> DataFrame:
    """keys, loss: sqrt(E[d^2] - balance * E[d]^2) of log errors d, over all pixels of a key."""
    d = F.log("gt") - F.log("pred")
    return px.groupBy(*keys).agg(F.avg(d * d).alias("e2"), F.avg(d).alias("e1")).select(*keys, F.sqrt(F.col("e2") - balance * F.col("e1") * F.col("e1")).alias("loss"))


def robustly_normalised(px: DataFrame, values: tuple[str, ...], mask: str = "mask", keys: tuple[str, ...] = CLIP_FRAME) -> DataFrame:
    """Each of ``values`` less the frame's middle, over its spread, as robust_bounds has them."""
    bounded = px.join(ev.robust_bounds_of(px, values, mask, keys), list(keys))
    scaled = {v: (F.col(v) - F.col(f"middle_{v}")) / F.col(f"spread_{v}") for v in values}
    return bounded.withColumns(scaled).select(*px.columns)


def trimmed_procrustes(px: DataFrame, alpha: float = 0.5, trim: float = 0.2, keys: tuple[str, ...] = CLIP_FRAME, image: tuple[str, ...] = CLIP_FRAME, normalise: bool = True, frame_h: int | None = None) -> DataFrame:
    """keys, loss of pred and target, both robustly normalised by image: trimmed mean error and ``alpha`` times the gradient loss of their difference.

    Only pixels whose column mask is true count, pooled over the images of a key;
    a key without any has loss 0.
    """
    both = robustly_normalised(px, ("pred", "target"), keys=image) if normalise else px
    data = ev.trimmed_mae(both.filter("mask").withColumnRenamed("target", "gt"), trim, keys).withColumnRenamed("loss", "data")
    out = px.select(*keys).distinct().join(data, list(keys), "left")
    loss = F.coalesce("data", F.lit(0.0))
    if alpha > 0:
        smooth = ev.gradient_loss(both.withColumn("diff", F.col("pred") - F.col("target")), "diff", keys=keys, image=image, mask="mask", frame_h=frame_h).withColumnRenamed("loss", "smooth")
        out, loss = out.join(smooth, list(keys)), loss + alpha * F.col("smooth")
    return out.select(*keys, loss.alias("loss"))


def video_depth_loss(px: DataFrame, alpha: float = 0.5, trim: float = 0.0, stable_scale: float = 10.0) -> DataFrame:
    """video, spatial, stable, total, over the pixels whose column mask is true.

    spatial: the Procrustes loss pooled over a video's frames. stable: the
    temporal gradient loss of neighbouring frames, ``stable_scale`` times, of pred
    fitted to target by one scale and shift per video.
    """
    spatial = trimmed_procrustes(px, alpha, trim, ("video",)).withColumnRenamed("loss", "spatial")
    fit = ev.scale_shift(px, ("video",), "pred", "target", "mask").select("video", F.col("loss_scale").alias("_s"), F.col("loss_shift").alias("_t"))
    fitted = px.join(fit, "video").withColumn("pred", F.col("_s") * F.col("pred") + F.col("_t"))
    stable = ev.temporal_gradient_loss(fitted, 1, trim=trim, mask="mask").select("video", (F.col("loss") * stable_scale).alias("stable"))
    both = spatial.join(stable, "video", "left").withColumn("stable", F.coalesce("stable", F.lit(0.0)))
    return both.withColumn("total", F.col("spatial") + F.col("stable"))


def split_means(frames: DataFrame, metrics: tuple[str, ...], excluded: Column, keys: tuple[str, ...]) -> DataFrame:
    """keys and, for each metric, its mean over all views and over those not excluded, in one pass."""
    means = [a for m in metrics for a in (F.avg(m).alias(f"{m}_all"), F.avg(F.when(~excluded, F.col(m))).alias(f"{m}_rest"))]
    return frames.groupBy(*keys).agg(*means)


def combined(losses: DataFrame, spec: list[str]) -> DataFrame:
    """Add total: the losses named in ``spec`` (``weight_name``), weighted as weighted_losses has it."""
    total = F.lit(0.0)
    for weight, name in ev.weighted_losses(spec):
        total = total + weight * F.col(name)
    return losses.withColumn("total", total)
