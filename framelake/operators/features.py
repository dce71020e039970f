"""Operators over feature vectors: similarities, Gram matrices, softmax expectations, attention, moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import dot, norm


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.greatest(norm(a) * norm(b), F.lit(1e-10)))


def cosine_to_centre(rows: DataFrame, key: str, vector: str, item: str) -> DataFrame:
    """key, item, cosine to the key's mean vector."""
    parts = rows.select(key, F.posexplode(vector).alias("i", "v"))
    means = parts.groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    return rows.join(centre, key).select(key, item, cosine(F.col(vector), F.col("centre")).alias("cosine"))


def layer_distance(rows: DataFrame, keys: list[str], layer: str, a: str, b: str, eps: float = 1e-10) -> DataFrame:
    """keys, distance: the sum over layers of 1 less the mean cosine over a layer's places; a row is a place with its two vectors."""
    # Lengths are taken with eps added to each, so that a zero vector has cosine 0.
    alike = dot(F.col(a), F.col(b)) / ((norm(F.col(a)) + eps) * (norm(F.col(b)) + eps))
    layers = rows.groupBy(*keys, layer).agg((1 - F.avg(alike)).alias("_d"))
    return layers.groupBy(*keys).agg(F.sum("_d").alias("distance"))


def view_weighted(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys and the mean of value over a key's views by their weights; null where these sum to 0."""
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value))


def gram(rows: DataFrame, key: str, vector: str, channels: int) -> DataFrame:
    """key, i, j, g for i <= j: mean product of two channels over the key's rows.

    Each row gives its own channels * (channels + 1) / 2 products, summed before the shuffle.
    """
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: F.transform(F.sequence(i, F.lit(channels - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get(vector, i).cast("double") * F.get(vector, j).cast("double")).alias("p")))))
    return rows.select(key, F.explode(pairs).alias("c")).groupBy(key, "c.i", "c.j").agg(F.avg("c.p").alias("g"))


def group_correlation(a: Column, b: Column, groups: int, length: int) -> Column:
    """Mean product over each of ``groups`` equal parts of two vectors."""
    size = length // groups
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: dot(F.slice(a, g * size + 1, size), F.slice(b, g * size + 1, size)) / float(size))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v.cast("double") - top.cast("double")))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, v: s + v))


def expectation(weights: Column, values: Column) -> Column:
    return dot(weights, values)


def soft_argmin(cost: Column, hypotheses: Column) -> Column:
    """Expected hypothesis under the softmax of costs."""
    return expectation(softmax(cost), hypotheses)


def photometric_confidence(p: Column) -> Column:
    """Mass of four neighbouring bins, d - 1 to d + 2, at the truncated expected index."""
    d = F.aggregate(F.transform(p, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v).cast("int")
    return F.aggregate(F.slice(p, F.greatest(d, F.lit(1)), F.when(d == 0, 3).otherwise(4)), F.lit(0.0), lambda s, v: s + v)


def attention(queries: DataFrame, keys: DataFrame, group: str, query: str, vector: str, value: str, size: int) -> DataFrame:
    """group, query, out: softmax over the group's keys of query . key / sqrt(size), times their values.

    ``keys`` are the few views of a group; a query meets those of its own group only.
    """
    met = queries.select(group, query, F.col(vector).alias("q")).join(keys.select(group, F.col(vector).alias("k"), F.col(value).alias("v")), group)
    scored = met.withColumn("s", dot(F.col("q"), F.col("k")) / float(size) ** 0.5)
    top = Window.partitionBy(group, query)
    weighted = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(top)))
    return weighted.groupBy(group, query).agg((F.sum(F.col("e") * F.col("v")) / F.sum("e")).alias("out"))


def moments(rows: DataFrame, vector: str) -> DataFrame:
    """i, mean, biased and unbiased variance of each component."""
    parts = rows.select(F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return parts.groupBy("i").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var_biased"), F.var_samp("v").alias("var_unbiased"))


def running_moments(rows: DataFrame, batch: str, vector: str, momentum: float = 0.1, mean: float = 0.0, variance: float = 1.0) -> DataFrame:
    """i, mean, variance after all batches in order: from the given start, each batch moves them by ``momentum`` to its mean and its unbiased variance.

    The recursion is a sum with weights that fall by 1 - momentum with each later
    batch, so batches aggregate side by side. A batch of one row moves the mean only.
    """
    parts = rows.select(batch, F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    each = parts.groupBy(batch, "i").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    later = Window.partitionBy("i").orderBy(F.col(batch).desc())
    aged = each.withColumn("_m", F.row_number().over(later) - 1).withColumn("_s", F.count("s").over(later) - 1)
    keep = 1 - momentum
    weight = lambda age: momentum * F.pow(F.lit(keep), F.col(age))
    return aged.groupBy("i").agg(
        (F.sum(F.col("m") * weight("_m")) + mean * F.pow(F.lit(keep), F.count("m"))).alias("mean"),
        (F.coalesce(F.sum(F.col("s") * weight("_s")), F.lit(0.0)) + variance * F.pow(F.lit(keep), F.count("s"))).alias("variance"),
    )


def trimmed_top(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def blended(logits: Column, values: Column) -> Column:
    """Candidates' values, weighted by the softmax of their logits."""
    return dot(softmax(logits), values)


def deviation(values: Column) -> Column:
    """Sample deviation of an array, null for fewer than two values."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    n = F.size(values).cast("double")
    return F.aggregate(
        values, zero,
        lambda a, v: F.struct((a["s"] + v.cast("double")).alias("s"), (a["q"] + v.cast("double") * v.cast("double")).alias("q")),
        lambda a: F.when(n > 1, F.sqrt(F.greatest(F.try_divide(a["q"] - a["s"] * a["s"] / n, n - 1), F.lit(0.0)))),
    )


def rescaled_guidance(guided: Column, text: Column, share: float) -> Column:
    """``guided`` with the deviation of ``text``, mixed with itself by ``share``."""
    ratio = F.try_divide(deviation(text), deviation(guided))
    # The ratio is an array of one, so that it is taken once and not for each component.
    return F.flatten(F.transform(F.array(ratio), lambda r: F.transform(guided, lambda v: share * v * r + (1 - share) * v)))


def batch_normalised(rows: DataFrame, vector: str, gain: float, bias: float, eps: float = 1e-5) -> DataFrame:
    """All columns but ``vector``, and i, v: each component as one scale and shift, from E[x^2] - E[x]^2 over all rows."""
    parts = rows.select(*[c for c in rows.columns if c != vector], F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    sums = parts.groupBy("i").agg(F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("m2"))
    scale = gain / F.sqrt(F.col("m2") - F.col("m") * F.col("m") + eps)
    fused = sums.select("i", scale.alias("_s"), (bias - F.col("m") * scale).alias("_t"))
    # A row per component: as long as a vector.
    return parts.join(F.broadcast(fused), "i").withColumn("v", F.col("v") * F.col("_s") + F.col("_t")).drop("_s", "_t")
