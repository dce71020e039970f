"""Exact deduplication by a tree merge of sorted digest runs.

Each partition of the digest table is a run. Runs meet in rounds: in round r,
the runs of ``fan_in`` neighbouring nodes are merged into one. A round is an
aggregation over (node, digest): Spark sorts each map task's rows into a run
and drops its repeats before the exchange, the exchange cuts every node's runs
by digest, and a sorted merge in the reduce task keeps the best row of each
digest. After log(partitions) rounds one node is left, spread over all reduce
tasks; no task ever holds a whole node, nor a group's members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import ASCII_SPACE, join_group_facts, materialise

#: Runs that meet in a node.
FAN_IN = 16


def normalised(text: Column) -> Column:
    """A text without its ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, code points, digest, and normalised length and a second hash to verify it, of each row, with no other column of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        F.length("text").cast("long").alias("chars"),
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"),
        F.struct(F.length(normalised(F.col("text"))).cast("long").alias("chars"), F.xxhash64(normalised(F.col("text"))).alias("hash")).alias("check"),
    )


def merge_runs(rows: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Best row and size of each digest, from rows with a column ``node`` in [0, runs).

    Two rows are the same text if digest, normalised length and a second hash of
    it agree; every level verifies them all and keeps the row with most code points, then the smallest
    doc_id (null ids last).
    """
    level = rows.select(
        "node", "digest", "check",
        F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid").alias("best"),
        F.lit(1).cast("long").alias("group_size"),
    )
    while True:
        level = (
            level.withColumn("node", F.floor(F.col("node") / fan_in))
            .groupBy("node", "digest", "check")
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
        runs = -(-runs // fan_in)
        if runs <= 1:
            return level.select("digest", "check", "best", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones. Ties in length go to the smaller doc_id, null
    ids last; of rows that agree in id and text as well, one stays. An empty
    table gives no rows. Further columns of ``docs`` are not read.
    """
    # The digests are written once: each text is hashed once, and uid can't change between the two reads.
    rows = materialise(digest_rows(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    runs = rows.rdd.getNumPartitions()
    best = materialise(merge_runs(rows.withColumn("node", F.shiftright("uid", 33)), runs, fan_in))
    shared = best.filter("group_size > 1").select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size"
    )
    joined = join_group_facts(rows, shared, "digest", "group_size", rows.count())
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns.

    Texts meet their decision by (digest, doc_id), so a hot group spreads over
    all tasks; only rows repeated in id and text need a further step: of those
    the first by all columns, written as JSON, stays, the same one in every run.
    """
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = whole.select(
        "row", "doc_id",
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
    )
    rows = materialise(digest_rows(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    best = merge_runs(rows.withColumn("node", F.shiftright("uid", 33)), rows.rdd.getNumPartitions(), fan_in)
    times = rows.groupBy("digest", "doc_id", "chars").agg(F.count("*").alias("times"))
    keep = best.select("digest", F.col("best.doc_id").alias("doc_id"), (-F.col("best.less")).alias("chars")).alias("b")
    same = lambda a, b: (F.col(f"{a}.digest") == F.col(f"{b}.digest")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.chars") == F.col(f"{b}.chars"))
    keep = materialise(keep.join(times.alias("t"), same("b", "t")).select("b.digest", "b.doc_id", "b.chars", "t.times"))
    kept = whole.alias("w").join(keep.alias("k"), same("w", "k")).select("w.row", "w.digest", "w.doc_id", "k.times")
    once = kept.filter("times = 1").select("row.*")
    again = kept.filter("times > 1").groupBy("digest", "doc_id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(again) if keep.filter("times > 1").limit(1).count() else once
