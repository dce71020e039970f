"""Depth accuracy: masks, scale-and-shift alignment, metrics over nested means, and losses.

Rows are pixels with pred and gt. Metrics that a frame has are means over its
valid pixels; a scene has the mean over frames, a dataset the mean over scenes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_DEPTH, MAX_DEPTH = 1e-3, 80.0
SCENE, FRAME = ("dataset", "scene"), ("dataset", "scene", "frame")


def valid(px: DataFrame, least: float = MIN_DEPTH, most: float = MAX_DEPTH) -> DataFrame:
    return px.filter((F.col("gt") > least) & (F.col("gt") < most))


def valid_inclusive(px: DataFrame, least: float, most: float, keys: tuple[str, ...] = FRAME, pixels: int = 10) -> DataFrame:
    """Pixels with least <= gt <= most, of the images that have ``pixels`` of them."""
    inside = px.filter(F.col("gt").between(least, most))
    enough = inside.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= pixels).drop("_n")
    return inside.join(enough, list(keys), "left_semi")


def ground_truth(raw: Column, factor: float) -> Column:
    """Raw depth over the dataset's factor; 0 is unknown."""
    return F.nullif(raw / factor, F.lit(0.0))


def fit_disparity(px: DataFrame, keys: tuple[str, ...] = SCENE) -> DataFrame:
    """keys, scale, shift: least squares of 1 / gt on predicted disparity, one fit per key."""
    target, given = 1 / (F.col("gt") + 1e-8), F.greatest(F.col("pred_disp"), F.lit(1e-3))
    return px.groupBy(*keys).agg(F.regr_slope(target, given).alias("scale"), F.regr_intercept(target, given).alias("shift"))


def align(px: DataFrame, keys: tuple[str, ...] = SCENE, most: float = MAX_DEPTH) -> DataFrame:
    """Add pred: depth of the aligned disparity, which is cut at 1e-3 below; depth lies between 1e-3 and ``most``."""
    aligned = F.greatest(F.col("scale") * F.greatest(F.col("pred_disp"), F.lit(1e-3)) + F.col("shift"), F.lit(1e-3))
    return px.join(fit_disparity(px, keys), list(keys)).withColumn("pred", F.least(F.greatest(1 / aligned, F.lit(1e-3)), F.lit(most)))


def scale_shift(px: DataFrame, keys: tuple[str, ...] = SCENE, pred: str = "p", target: str = "t", mask: str | None = None) -> DataFrame:
    """keys and the coefficients of the three closed forms, over the pixels whose column ``mask`` is true (all, if None).

    infer: (1, 0) if the determinant is 0. loss: 1e-6 in the denominator, (0, 0) if
    the determinant is 0. only: scale alone, with 1e-6.
    """
    p, t = F.col(pred), F.col(target)
    known = F.lit(True) if mask is None else F.col(mask)
    total = lambda c, name: F.sum(F.when(known, c).otherwise(0.0)).alias(name)
    sums = px.groupBy(*keys).agg(total(p * p, "pp"), total(p, "sp"), total(F.lit(1.0), "n"), total(p * t, "pt"), total(t, "st"))
    det = F.col("pp") * F.col("n") - F.col("sp") * F.col("sp")
    scale, shift = F.col("n") * F.col("pt") - F.col("sp") * F.col("st"), -F.col("sp") * F.col("pt") + F.col("pp") * F.col("st")
    none = det == 0
    return sums.select(
        *keys,
        F.when(none, 1.0).otherwise(F.try_divide(scale, det)).alias("infer_scale"), F.when(none, 0.0).otherwise(F.try_divide(shift, det)).alias("infer_shift"),
        F.when(none, 0.0).otherwise(scale / (det + 1e-6)).alias("loss_scale"), F.when(none, 0.0).otherwise(shift / (det + 1e-6)).alias("loss_shift"),
        (F.col("pt") / (F.col("pp") + 1e-6)).alias("only_scale"),
    )


def frame_metrics(px: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """keys, n and every metric of a frame. log moments e1, e2 belong to silog."""
    p, g = F.col("pred"), F.col("gt")
    ratio, log = F.greatest(p / g, g / p), F.log(p) - F.log(g)
    share = lambda k: F.avg(F.when(ratio < 1.25**k, 1.0).otherwise(0.0))
    return px.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(p - g) / g).alias("abs_rel"), F.avg((p - g) * (p - g) / g).alias("sq_rel"),
        F.sqrt(F.avg((p - g) * (p - g))).alias("rmse"), F.sqrt(F.avg(log * log)).alias("rmse_log"),
        share(1).alias("d1"), share(2).alias("d2"), share(3).alias("d3"),
        F.sqrt(F.avg((1 / g - 1 / p) * (1 / g - 1 / p))).alias("i_rmse"),
        F.avg(log * log).alias("e2"), F.avg(log).alias("e1"), F.avg(F.abs(F.log10(p) - F.log10(g))).alias("log10"),
    )


def scene_metrics(frames: DataFrame, keys: tuple[str, ...] = SCENE) -> DataFrame:
    """Means over frames; silog is 100 times the root of the mean variance of log errors."""
    means = [F.avg(c).alias(c) for c in ("abs_rel", "sq_rel", "rmse", "rmse_log", "d1", "d2", "d3", "i_rmse")]
    return frames.groupBy(*keys).agg(*means, (F.sqrt(F.avg(F.col("e2") - F.col("e1") * F.col("e1"))) * 100).alias("silog"))


def pooled_log10(px: DataFrame, keys: tuple[str, ...] = SCENE) -> DataFrame:
    return px.groupBy(*keys).agg(F.avg(F.abs(F.log10("pred") - F.log10("gt"))).alias("log10"))


def image_metrics_mean(px: DataFrame, image: tuple[str, ...] = FRAME, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """The nine metrics of each image, then their mean over images; silog here is sqrt(E[d2] - E[d]2 / 2)."""
    names = ("d1", "d2", "d3", "abs_rel", "sq_rel", "rmse", "rmse_log", "log10", "silog")
    images = frame_metrics(px, image).withColumn("silog", F.sqrt(F.col("e2") - 0.5 * F.col("e1") * F.col("e1")))
    return images.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])


def mean_over(rows: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])


def robust_bounds(px: DataFrame, value: str = "v", mask: str = "mask", keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """keys, middle (lower median, masked-out pixels entering as 0), spread (masked mean absolute deviation, 1e-6 at least; 1 if all is masked out)."""
    found = robust_bounds_of(px, (value,), mask, keys)
    return found.select(*keys, F.col(f"middle_{value}").alias("middle"), F.col(f"spread_{value}").alias("spread"))


def robust_bounds_of(px: DataFrame, values: tuple[str, ...], mask: str = "mask", keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """keys, and middle_<value> and spread_<value> of each value: all middles in one pass, then all spreads."""
    given = px.select(*keys, mask, *values)
    entered = given.select(*keys, *[F.when(F.col(mask), F.col(v)).otherwise(0.0).alias(f"_e{i}") for i, v in enumerate(values)])
    middles = entered.groupBy(*keys).agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY _e{i})").alias(f"middle_{v}") for i, v in enumerate(values)])
    known = F.count(F.when(F.col(mask), 1))

    def spread(v: str) -> Column:
        off = F.sum(F.when(F.col(mask), F.abs(F.col(v) - F.col(f"middle_{v}"))))
        return F.when(known == 0, 1.0).otherwise(F.greatest(F.try_divide(off, known), F.lit(1e-6))).alias(f"spread_{v}")

    return given.join(middles, list(keys)).groupBy(*keys, *[f"middle_{v}" for v in values]).agg(*[spread(v) for v in values])


def trimmed_mae(px: DataFrame, trim: float = 0.2, keys: tuple[str, ...] = SCENE, per_octave: int = 64) -> DataFrame:
    """Sum of the smallest int(n (1 - trim)) absolute errors over all n.

    Counts and sums per bucket of the residuals' logarithm tell in which bucket
    the cut falls; only that bucket's residuals are ranked, equal ones as one row.
    """
    if trim == 0:
        return px.groupBy(*keys).agg(F.avg(F.abs(F.col("pred") - F.col("gt"))).alias("loss")).filter("loss IS NOT NULL")
    bucket = F.coalesce(F.floor(F.log2("residual") * per_octave), F.lit(-(1 << 20))).cast("int")  # 0 has no logarithm and comes first
    placed = px.select(*keys, F.abs(F.col("pred") - F.col("gt")).alias("residual")).filter("residual IS NOT NULL").withColumn("_b", bucket)
    key = Window.partitionBy(*keys)
    sums = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.sum("residual").alias("_s"))
    sums = sums.withColumn("_upto", F.sum("_c").over(key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(key))
    below = F.col("_upto") < F.floor(F.col("n") * (1 - trim))
    cut = sums.groupBy(*keys, "n").agg(
        F.coalesce(F.sum(F.when(below, F.col("_s"))), F.lit(0.0)).alias("part"),
        F.min(F.when(~below, F.struct("_b", (F.col("_upto") - F.col("_c")).alias("before")))).alias("_cut"),
    ).select(*keys, "n", "part", "_cut._b", (F.floor(F.col("n") * (1 - trim)) - F.col("_cut.before")).alias("_left"))
    values = placed.join(cut, [*keys, "_b"]).groupBy(*keys, "n", "part", "_left", "residual").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(key.orderBy("residual").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.least(F.col("_c"), F.greatest(F.col("_left") - before, F.lit(0)))
    inside = values.withColumn("_t", taken).groupBy(*keys, "n", "part").agg(F.sum(F.col("residual") * F.col("_t")).alias("inside"))
    return inside.select(*keys, ((F.col("part") + F.col("inside")) / F.col("n")).alias("loss"))


def batch_and_image_means(images: DataFrame, loss: str = "loss", weight: str = "n", keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """batch: sum of losses over sum of weights. image: mean of each image's ratio, 0 for empty images."""
    return images.groupBy(*keys).agg(F.try_divide(F.sum(loss), F.sum(weight)).alias("batch"), F.avg(F.coalesce(F.try_divide(F.col(loss), F.col(weight)), F.lit(0.0))).alias("image"))


def gradient_parts(px: DataFrame, value: str = "diff", strides: tuple[int, ...] = (1, 2, 4, 8), image: tuple[str, ...] = ("video", "frame"), mask: str | None = None, frame_h: int | None = None) -> DataFrame:
    """image, stride, loss, n: summed absolute differences between neighbours on the grid of each stride, and its known pixels.

    A difference counts if both pixels are there and their column ``mask`` is
    true (all are, if None). Where an image is several frames of ``frame_h`` rows
    one below the other, none counts across frames.
    """
    known = F.lit(True) if mask is None else F.col(mask)
    grid = px.withColumn("stride", F.explode(F.array(*[F.lit(s) for s in strides]))).filter((F.col("y") % F.col("stride") == 0) & (F.col("x") % F.col("stride") == 0))
    for along, across in (("x", "y"), ("y", "x")):
        order = Window.partitionBy(*image, "stride", across).orderBy(along)
        before = F.lag(along).over(order)
        counts = (F.col(along) - before == F.col("stride")) & known & F.lag(known).over(order)
        if frame_h and along == "y":
            counts &= F.floor(F.col("y") / frame_h) == F.floor(before / frame_h)
        grid = grid.withColumn(f"_g{along}", F.when(counts, F.abs(F.col(value) - F.lag(value).over(order))).otherwise(0.0))
    return grid.groupBy(*image, "stride").agg(F.sum(F.col("_gx") + F.col("_gy")).alias("loss"), F.count(F.when(known, 1)).alias("n"))


def gradient_loss(
    px: DataFrame, value: str = "diff", strides: tuple[int, ...] = (1, 2, 4, 8), keys: tuple[str, ...] = ("video", "frame"),
    image: tuple[str, ...] = ("video", "frame"), mask: str | None = None, frame_h: int | None = None, reduction: str = "batch",
) -> DataFrame:
    """keys, loss: gradient_parts of the images of each key, reduced per stride and summed over strides.

    ``batch``: sum of losses over sum of known pixels, 0 without any. ``image``:
    mean over images of each one's ratio, 0 for one without known pixels.
    """
    parts = gradient_parts(px, value, strides, image, mask, frame_h)
    ratio = F.try_divide(F.col("loss"), F.col("n"))
    reduced = F.try_divide(F.sum("loss"), F.sum("n")) if reduction == "batch" else F.avg(F.coalesce(ratio, F.lit(0.0)))
    return parts.groupBy(*keys, "stride").agg(F.coalesce(reduced, F.lit(0.0)).alias("part")).groupBy(*keys).agg(F.sum("part").alias("loss"))


def temporal_gradient_loss(
    px: DataFrame, scales: int = 4, decay: float = 0.5, share: float = 0.05, trim: float = 0.2, mask: str | None = None, keys: tuple[str, ...] = ("video",), order: str = "frame",
) -> DataFrame:
    """keys, loss: errors of pred's steps against target's, pixel by pixel, between frames 1, 2, 4 ... apart.

    Frames count from a key's first one; a stride takes part if the key has more
    frames than it. A step counts if both its pixels are known and the target
    moves by less than ``share`` of the range of the later frame's known target.
    Of a stride's errors the greatest ``trim`` are left out, and their sum is over
    all; strides are weighted by ``decay`` to the power of their place, and the
    sum is over their number.
    """
    known = F.lit(True) if mask is None else F.col(mask)
    frames = px.groupBy(*keys, order).agg(((F.max(F.when(known, F.col("target"))) - F.min(F.when(known, F.col("target")))) * share).alias("_most"))
    spans = px.groupBy(*keys).agg(F.min(order).alias("_from"), (F.max(order) - F.min(order) + 1).alias("_frames"))
    levels = F.array(*[F.lit(2**i) for i in range(scales)])
    spans = spans.withColumn("_strides", F.filter(levels, lambda s: s < F.col("_frames"))).filter(F.size("_strides") > 0)
    each = px.filter(known).join(spans, list(keys)).withColumn("_i", F.col(order) - F.col("_from")).withColumn("stride", F.explode("_strides")).filter(F.col("_i") % F.col("stride") == 0)
    same = Window.partitionBy(*keys, "stride", "y", "x").orderBy("_i")
    step = lambda c: F.col(c) - F.lag(c).over(same)
    moved = each.select(*keys, order, "stride", (step("_i") == F.col("stride")).alias("_next"), step("pred").alias("pred"), step("target").alias("gt")).filter("_next")
    still = moved.join(frames, [*keys, order]).filter(F.abs("gt") < F.col("_most"))
    parts = trimmed_mae(still, trim, (*keys, "stride")).select(*keys, (F.col("loss") * F.pow(F.lit(float(decay)), F.log2("stride"))).alias("part"))
    sums = parts.groupBy(*keys).agg(F.sum("part").alias("part"))
    return spans.join(sums, list(keys), "left").select(*keys, (F.coalesce("part", F.lit(0.0)) / F.size("_strides")).alias("loss"))


def smooth_l1(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def depth_losses(px: DataFrame, keys: tuple[str, ...] = SCENE, known: float = 1e-4) -> DataFrame:
    """keys, l1, l2, smooth: mean losses of pred over the pixels whose gt is over ``known``; 0 for a key without any. Give a stage as one of the keys."""
    d = F.when(F.col("gt") > known, F.col("pred") - F.col("gt"))
    means = {"l1": F.avg(F.abs(d)), "l2": F.avg(d * d), "smooth": F.avg(F.when(d.isNotNull(), smooth_l1(d, F.lit(0.0))))}
    return px.groupBy(*keys).agg(*[F.coalesce(m, F.lit(0.0)).alias(n) for n, m in means.items()])


def stereo_mae(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """Mean absolute error over pixels and channels of each image that both sides have."""
    on = [*keys, "y", "x"]
    both = left.select(*on, "r", "g", "b").join(right.select(*on, *[F.col(c).alias(f"{c}2") for c in "rgb"]), on)
    return both.groupBy(*keys).agg((F.sum(F.abs(F.col("r") - F.col("r2")) + F.abs(F.col("g") - F.col("g2")) + F.abs(F.col("b") - F.col("b2"))) / (3 * F.count("*"))).alias("mae"))


def psnr(both: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """Squared errors sum over channels and average over pixels; of equal images the ratio is infinite."""
    square = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in channels), F.lit(0.0))
    ratio = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(F.try_divide(F.lit(1.0), F.col("mse"))))
    return both.groupBy(*keys).agg(F.avg(square).alias("mse")).withColumn("psnr", ratio)


def gaussian(size: int = 11, sigma: float = 1.5) -> list[float]:
    import math

    weights = [math.exp(-((i - size // 2) ** 2) / (2 * sigma**2)) for i in range(size)]
    return [w / sum(weights) for w in weights]


def blur(grid: DataFrame, columns: dict[str, Column], size: int = 11, sigma: float = 1.5, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """Add Gaussian means of ``columns`` on a dense grid, zero beyond its edges: along x, then along y."""
    weights, half = gaussian(size, sigma), size // 2
    for name, c in columns.items():
        grid = grid.withColumn(name, c)
    for along, across in (("x", "y"), ("y", "x")):
        order = Window.partitionBy(*keys, across).orderBy(along)
        sums = {n: sum((F.coalesce(F.lag(n, half - i).over(order), F.lit(0.0)) * w for i, w in enumerate(weights)), F.lit(0.0)) for n in columns}
        grid = grid.withColumns(sums)
    return grid


def ssim(grid: DataFrame, a: str, b: str, keys: tuple[str, ...] = ("video", "frame"), mask: str | None = None) -> DataFrame:
    """Mean structural similarity of two columns of a dense grid by frame, dynamic range 1; weighted by ``mask``, whose sum counts as 1 at least."""
    x, y = F.col(a), F.col(b)
    g = blur(grid, {"_x": x, "_y": y, "_xx": x * x, "_yy": y * y, "_xy": x * y}, keys=keys)
    mx, my = F.col("_x"), F.col("_y")
    vx, vy, vxy = F.col("_xx") - mx * mx, F.col("_yy") - my * my, F.col("_xy") - mx * my
    value = (2 * mx * my + 1e-4) * (2 * vxy + 9e-4) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4))
    if mask is not None:
        return g.groupBy(*keys).agg((F.sum(value * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1.0))).alias("ssim"))
    return g.groupBy(*keys).agg(F.avg(value).alias("ssim"))


def box_ssim(grid: DataFrame, pairs: list[tuple[str, str]], h: int, w: int, size: int = 7, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """Mean structural similarity by frame over pairs of columns of a dense grid, range 1: plain means of size x size
    windows, unbiased covariances, and only pixels whose window lies inside."""
    half, unbiased = size // 2, size * size / (size * size - 1)
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a), F.col(b)
        grid = grid.withColumns({f"_x{i}": x, f"_y{i}": y, f"_xx{i}": x * x, f"_yy{i}": y * y, f"_xy{i}": x * y})
    names = [f"_{n}{i}" for i in range(len(pairs)) for n in ("x", "y", "xx", "yy", "xy")]
    for along, across in (("x", "y"), ("y", "x")):
        box = Window.partitionBy(*keys, across).orderBy(along).rowsBetween(-half, half)
        grid = grid.withColumns({n: F.sum(n).over(box) / size for n in names})
    similar = []
    for i in range(len(pairs)):
        mx, my, xx, yy, xy = (F.col(f"_{n}{i}") for n in ("x", "y", "xx", "yy", "xy"))
        vx, vy, vxy = (xx - mx * mx) * unbiased, (yy - my * my) * unbiased, (xy - mx * my) * unbiased
        similar.append((2 * mx * my + 1e-4) * (2 * vxy + 9e-4) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4)))
    inside = F.col("y").between(half, h - 1 - half) & F.col("x").between(half, w - 1 - half)
    return grid.filter(inside).groupBy(*keys).agg((F.avg(sum(similar, F.lit(0.0))) / len(pairs)).alias("ssim"))


def weighted_losses(spec: list[str]) -> list[tuple[float, str]]:
    """("1.0_l1", ...) as (weight, name); the first loss has weight 1 whatever it says."""
    parts = [s.split("_", 1) for s in spec]
    return [(1.0 if i == 0 else float(w), n) for i, (w, n) in enumerate(parts)]
