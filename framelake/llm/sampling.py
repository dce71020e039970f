"""Bounded samples from which models are fitted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import materialise


def fraction_of(doc_id: Column) -> Column:
    """A number in [0, 1) that a document keeps in every run."""
    digest = F.md5(F.concat(F.lit("fit:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)


def bounded_rows(known: DataFrame, texts: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """About ``most_rows`` rows of (doc_id, text, label) at most, and about ``most_chars`` of text.

    ``known`` has doc_id and label, ``texts`` doc_id and text. Rows are chosen by
    a hash of doc_id and text, so reruns agree and an id that repeats can't swell
    the sample; equal rows count once. Texts are whole. Only hashes meet labels by
    shuffle; the chosen ones, bounded by ``most_rows``, then fetch their texts.
    """
    hashed = texts.select("doc_id", F.xxhash64("text").alias("_text"), F.length("text").alias("_chars"))
    narrow = materialise(hashed.join(known, "doc_id").distinct())
    n, chars = narrow.agg(F.count("*"), F.sum("_chars")).first()
    part = min(1.0, most_rows / max(1, n), most_chars / max(1, chars or 0))
    draw = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_text")
    chosen = narrow.filter(fraction_of(draw) < part).select("doc_id", "_text", "label")
    return texts.withColumn("_text", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "_text"]).select("doc_id", "text", "label").distinct()


def bounded_texts(known: DataFrame, texts: DataFrame, most_rows: int, most_chars: int) -> pd.DataFrame:
    """The rows of bounded_rows() in order, on the driver."""
    kept = bounded_rows(known, texts, most_rows, most_chars).toPandas()
    return kept.sort_values(["doc_id", "text", "label"], ignore_index=True)


def labelled_texts(rows: DataFrame, most_rows: int, most_chars: int) -> pd.DataFrame:
    """A sample of (doc_id, text, label) that has every label, on the driver.

    Half of ``most_rows`` and ``most_chars`` is shared evenly by the labels, half
    by their size, so a rare label stays however large the table is, and a long
    text costs only its own label others. Of each label the text that comes first
    stays in any case. Rows are chosen by a hash of doc_id and text, so reruns
    agree; texts are whole, and equal rows count once.
    """
    draw = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"))
    rows = rows.withColumn("_f", fraction_of(draw))
    labels = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("_f").alias("least")).toPandas()
    share = lambda x: x / max(1, x.sum()) / 2 + 0.5 / max(1, len(x))
    part = np.minimum(most_rows * share(labels.n) / labels.n, most_chars * share(labels.chars) / np.maximum(1, labels.chars))
    limits = [(r.label, float(p), float(r.least)) for r, p in zip(labels.itertuples(), part, strict=True)]
    parts = rows.sparkSession.createDataFrame(limits, rows.select("label", F.lit(0.0).alias("part"), F.lit(0.0).alias("least")).schema)
    chosen = rows.join(F.broadcast(parts), "label").filter((F.col("_f") < F.col("part")) | (F.col("_f") == F.col("least")))
    kept = chosen.select("doc_id", "text", "label").distinct().toPandas()
    return kept.sort_values(["doc_id", "text", "label"], ignore_index=True)
