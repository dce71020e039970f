"""Packing by optimal length buckets.

A global histogram of piece lengths, at most ``max_len`` + 1 counts whatever the
input, goes to the driver. Dynamic programming over it chooses the bucket
lengths with the least padding. Token-budget batches then form inside each
bucket in the order of documents: a range sort on (bucket, doc_id, piece) gives
each partition its run, sums over the runs give it its first place, and a
place divided by the bucket's capacity is a batch. No bucket lies in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import materialise, shuffle_partitions, word_count

#: Words in a piece at most, number of buckets, and words in a batch, padding included.
MAX_LEN, BUCKETS, BUDGET = 2048, 8, 65_536


def bucket_lengths(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of exactly min(buckets, distinct lengths) buckets with the least padding.

    Among equal choices, each bucket from the last on starts as low as it can.
    """
    order = np.argsort(lengths)
    size = np.asarray(lengths, dtype=np.int64)[order]
    n = len(size)
    if not n:
        return []
    count = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64)[order])])
    words = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64)[order] * size)])
    far = np.iinfo(np.int64).max // 4
    best, starts = np.where(np.arange(n + 1) == 0, 0, far), []
    for _ in range(min(buckets, n)):
        new, start = np.full(n + 1, far), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (count[j] - count[:j]) - (words[j] - words[:j])
            start[j] = cost.argmin()
            new[j] = cost[start[j]]
        best = new
        starts.append(start)
    tops, j = [], n
    for start in reversed(starts):
        tops.append(int(size[j - 1]))
        j = start[j]
    return tops[::-1]


def length_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, piece, n_words: texts over ``max_len`` words go on in further pieces, and none is cut short."""
    sized = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("words"))
    last = F.floor(F.greatest(F.col("words") - 1, F.lit(0)) / max_len)
    return sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).select(
        "doc_id", "piece", F.least(F.col("words") - F.col("piece") * max_len, F.lit(max_len)).cast("long").alias("n_words")
    )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET,
) -> DataFrame:
    """One row per piece: doc_id, piece, n_words, bucket, bucket_len, batch, slot, padding.

    A piece is ``max_len`` words of a document, its last piece the rest; a null or
    empty text is one piece of 0 words. bucket counts from 0 by bucket_len; batch
    counts from 0 inside a bucket; a batch has at most max(1, budget div
    bucket_len) slots. Pieces lie by doc_id (null last), piece and n_words; rows that agree
    in these lie in any order. An empty table gives no rows. Further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    pieces = materialise(length_pieces(docs, id_col, text_col, max_len).withColumn("uid", F.monotonically_increasing_id()))
    histogram = pieces.groupBy("n_words").count().collect()
    tops = bucket_lengths([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    if not tops:
        tops = [0]
    table = F.array(*[F.lit(t).cast("long") for t in tops])
    bucket = sum(((F.col("n_words") > t).cast("int") for t in tops[:-1]), F.lit(0))
    order = [F.col("bucket").asc(), F.col("doc_id").asc_nulls_last(), F.col("piece").asc(), F.col("n_words").asc(), F.col("uid").asc()]
    sorted_rows = materialise(
        pieces.withColumn("bucket", bucket)
        .repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .drop("uid")
    )
    run = F.shiftright("at", 33).alias("run")
    runs = sorted_rows.groupBy(run, "bucket").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("bucket").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each bucket that a partition touches: at most partitions + buckets rows.
    firsts = runs.select("run", "bucket", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    placed = sorted_rows.withColumn("run", run).join(F.broadcast(firsts), ["run", "bucket"])
    place = F.col("before") + F.col("at") - F.col("first")
    top = F.element_at(table, F.col("bucket") + 1)
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(top, F.lit(1)))).cast("long")
    return placed.select(
        "doc_id", "piece", "n_words", F.col("bucket").cast("int").alias("bucket"), top.alias("bucket_len"),
        F.floor(place / fits).cast("long").alias("batch"), (place % fits).cast("long").alias("slot"),
        (top - F.col("n_words")).cast("long").alias("padding"),
    )


def sql(max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same in DuckDB's SQL, a common table expression for each bucket of the dynamic programme."""
    steps = "".join(
        f""",
dp{k} AS (
  SELECT b.r AS r, min({{'cost': a.cost + b.len * (b.c - a.c) - (b.s - a.s), 'start': a.r}}) AS m
  FROM (SELECT h.r, h.c, h.s, {'0' if k == 1 else 'd.m.cost'} AS cost FROM upto h {'' if k == 1 else f'JOIN dp{k - 1} d ON d.r = h.r'} {'WHERE h.r = 0' if k == 1 else ''}) a
  JOIN upto b ON a.r < b.r GROUP BY b.r)"""
        for k in range(1, buckets + 1)
    )
    final = " UNION ALL ".join(f"SELECT {k} AS k, r, m.start AS start FROM dp{k}" for k in range(1, buckets + 1))
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS words FROM documents),
pieces AS (
  SELECT doc_id, piece, least(words - piece * {max_len}, {max_len}) AS n_words
  FROM (SELECT *, unnest(range(0, greatest(words - 1, 0) // {max_len} + 1)) AS piece FROM sized)),
hist AS (SELECT n_words AS len, count(*) AS n FROM pieces GROUP BY n_words),
upto AS (
  SELECT row_number() OVER (ORDER BY len) AS r, len, CAST(sum(n) OVER (ORDER BY len) AS BIGINT) AS c, CAST(sum(n * len) OVER (ORDER BY len) AS BIGINT) AS s FROM hist
  UNION ALL SELECT 0, 0, 0, 0){steps},
steps AS ({final}),
walk AS (
  SELECT least({buckets}, (SELECT count(*) FROM hist)) AS k, (SELECT count(*) FROM hist) AS r
  UNION ALL
  SELECT w.k - 1, s.start FROM walk w JOIN steps s ON s.k = w.k AND s.r = w.r WHERE w.k > 1),
tops AS (SELECT w.k - 1 AS bucket, u.len AS bucket_len FROM walk w JOIN upto u ON u.r = w.r),
bucketed AS (
  SELECT p.*, (SELECT min(t.bucket) FROM tops t WHERE t.bucket_len >= p.n_words) AS bucket FROM pieces p),
placed AS (
  SELECT b.doc_id, b.piece, b.n_words, b.bucket, t.bucket_len,
         row_number() OVER (PARTITION BY b.bucket ORDER BY b.doc_id NULLS LAST, b.piece, b.n_words) - 1 AS place,
         greatest(1, {budget} // greatest(t.bucket_len, 1)) AS fits
  FROM bucketed b JOIN tops t ON t.bucket = b.bucket)
SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST(n_words AS BIGINT) AS n_words, CAST(bucket AS INTEGER) AS bucket, CAST(bucket_len AS BIGINT) AS bucket_len,
       CAST(place // fits AS BIGINT) AS batch, CAST(place % fits AS BIGINT) AS slot, CAST(bucket_len - n_words AS BIGINT) AS padding
FROM placed
"""
