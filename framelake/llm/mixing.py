"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents lie in key
order; the order is cut into ranges of the key space, so a source of any size
spreads over many tasks. Sums per (source, range) give each range its offset,
a running sum inside the range gives each document its place in the source's
words, and the source's budget is cut at its exact word: whole epochs first,
then the words before the cut once more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import materialise, word_count

#: Sources by code point take these weights in turn; the mix has SHARE times all words; no source exceeds its words REPEATS times.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Documents in a range of keys, about.
RANGE_ROWS = 20_000


def mix_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """32 random hex digits of a document, from its id and text, so that rows without an id or with a common one spread as well."""
    words = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), words).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target of each row of ``sizes`` (source, source_size).

    ``sizes`` has one row per source: a configuration-sized table. A source's cap
    is ``repeats`` times its size. In the order of cap over weight, the first k
    sources stop at their caps for the least k that leaves no other source above
    its own: the fixed point of resharing the excess by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % n + 1).cast("int"))
    capped = sizes.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * repeats).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    )
    # The level that holds if this row and all after it are not capped; it is the level if it doesn't exceed this row's cap over weight.
    levels = capped.withColumn("level", level)
    fits = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("unnamed"), "source", "level"))).over(whole)
    return levels.withColumn("final", fits["level"]).select(
        "source", "source_size", F.when(F.col("final").isNull() | (F.col("cap") < F.col("weight") * F.col("final")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, key, source_size, target, taken, copies.

    size counts words (null text: 0); the null source is a source of its own, in
    the last place. taken sums, over a source, to the floor of its target: the
    document at the cut gives part of its words. copies rounds that to whole
    documents: the document at the cut counts if at least half of it, and an
    empty document if its place, lies before the cut. Rows that repeat lie side by
    side and each take their place; they are counted first, so that a group of
    any size is one row of a range. An empty table gives no rows.
    Further columns of ``docs`` are not read.
    """
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
        .select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text")).alias("key"))
        .groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("times"))
    )
    ranges = 1 << max(6, math.ceil(math.log2(max(1, rows.count() / range_rows))))
    place = F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("int")
    rows = rows.withColumn("range", place).withColumn("named", F.coalesce("source", F.lit("")))
    rows = rows.withColumn("unnamed", F.col("source").isNull())
    per_range = rows.groupBy("named", "unnamed", "range").agg(F.sum(F.col("size") * F.col("times")).alias("words"))
    before = Window.partitionBy("named", "unnamed").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    sizes = per_range.groupBy("named", "unnamed").agg(F.sum("words").alias("source_size"))
    targets = source_targets(
        sizes.select(F.when(~F.col("unnamed"), F.col("named")).alias("source"), "source_size"), weights, share, repeats
    ).select(F.coalesce("source", F.lit("")).alias("named"), F.col("source").isNull().alias("unnamed"), "source_size", "target")
    facts = materialise(offsets.drop("words").join(targets, ["named", "unnamed"]))
    inside = Window.partitionBy("named", "unnamed", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum(F.col("size") * F.col("times")).over(inside)).join(facts, ["named", "unnamed", "range"])
    # Repeats are dealt out a thousand at a time.
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(1000).cast("long"))))
    placed = placed.withColumn("nth", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + 999, F.col("times") - 1))))
    start = F.col("offset") + F.col("upto") - F.col("size") * (F.col("times") - F.col("nth"))
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.expr("try_divide(floor(target), source_size)").cast("long"), F.lit(0))
    rest = budget - F.col("epochs") * F.col("source_size")
    once_more = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("start")))
    return placed.withColumn("start", start).withColumn("epochs", epochs).select(
        "doc_id", "source", "size", "key", "source_size", "target",
        (F.col("epochs") * F.col("size") + once_more).alias("taken"),
        (F.col("epochs") + (F.col("start") * 2 + F.col("size") <= rest * 2).cast("long")).alias("copies"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as mix_sources has copies of it, with all their columns.

    Rows meet their copies by (doc_id, source, key), the key telling texts apart;
    rows that agree in all three share the copies that fall to them, the higher
    counts first by all columns, written as JSON.
    """
    names = docs.columns
    text, source = options.get("text_col", "text"), options.get("source_col", "source")
    mixed = materialise(
        mix_sources(docs, id_col, **options)
        .groupBy("doc_id", "source", "key", "copies").agg(F.count("*").alias("rows"))
        .groupBy("doc_id", "source", "key")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("copies")).alias("less"), "rows"))).alias("shares"), F.sum("rows").alias("rows"))
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), mix_key(F.col(id_col), F.col(text)).alias("key"),
    )
    a, b = whole.alias("a"), mixed.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.key") == F.col("b.key"))
    met = a.join(b, same).select("a.row", F.col("a.doc_id").alias("doc_id"), F.col("a.source").alias("source"), F.col("a.key").alias("key"), "b.shares", "b.rows")
    # Repeats have a few counts at most: that of all whole epochs, one more, and one at the cut.
    out = met.filter(F.size("shares") == 1).select("row", (-F.col("shares")[0]["less"]).alias("n"))
    if mixed.filter(F.size("shares") > 1).limit(1).count():
        # Only the group that the cut of its source goes through: one for each source at most.
        nth = F.row_number().over(Window.partitionBy("doc_id", "source", "key").orderBy(F.to_json("row")))
        tied = met.filter(F.size("shares") > 1).withColumn("nth", nth)
        of = F.aggregate("shares", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("n")), lambda acc, s: F.struct((acc["upto"] + s["rows"]).alias("upto"), F.coalesce(acc["n"], F.when(F.col("nth") <= acc["upto"] + s["rows"], -s["less"])).alias("n")))
        out = out.unionByName(tied.select("row", of["n"].alias("n")))
    return out.filter("n > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
capped AS (
  SELECT source, source_size, source_size * 2 AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER w, 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM capped
  WINDOW w AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT level AS final FROM levels WHERE cap / CAST(weight AS DOUBLE) >= level
  ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN final IS NULL OR cap < weight * final THEN CAST(cap AS DOUBLE) ELSE weight * final END AS target
  FROM levels LEFT JOIN chosen ON true),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized),
cut AS (
  SELECT p.doc_id, p.size, p.start, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target) AS BIGINT) // t.source_size END AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM cut
"""
