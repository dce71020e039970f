"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word and normalisation rule here: U+0020 and U+0009 to U+000D, nothing else.
ASCII_SPACE = " \t\n\x0b\f\r"
#: A word, for Java's and DuckDB's regular expressions alike.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Documents whose id's CRC-32 leaves this remainder modulo 5 are held out of every training set.
HELD_OUT_FOLDS, HELD_OUT_FOLD = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_checkpoint_folder(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir, the cluster's shared folder.

    Only where the session names none (tests on one machine) is a folder made here.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder name inside the checkpoint folder."""
    set_checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once under spark.checkpoint.dir and go on from the written rows."""
    set_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a small intermediate table that a task takes, about, and tasks it has at least.
TASK_ROWS, LEAST_TASKS = 20_000, 16


def materialise_small(df: DataFrame, rows: int) -> DataFrame:
    """materialise() in tasks of about TASK_ROWS of at most ``rows`` narrow rows, so that their number follows the rows and not the session's setting."""
    return materialise(df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS))))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether a document stays out of training. A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_FOLDS == HELD_OUT_FOLD


def join_group_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join of ``rows`` to one row of ``facts`` per key, safe for groups of any size.

    ``facts`` has the group's row count in column ``size``. Of the groups over
    total/parts rows there are fewer than ``parts``, so these go out by broadcast,
    bounded whatever the input; all other keys meet by shuffle, none of them large.
    Keys without facts keep nulls.
    """
    limit = max(1, total // parts)
    large = F.broadcast(facts.filter(F.col(size) > limit))
    small = facts.filter(F.col(size) <= limit)
    return (
        rows.join(large, key)
        .unionByName(rows.join(large.select(key), key, "left_anti").join(small, key, "left"))
    )
