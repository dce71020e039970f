"""File listings and text lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import basename, stem, suffix


def list_files(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """path, length, in order of path: the lines of a .txt list that exist, one file, or all files below a folder that match."""
    if path.endswith(".txt"):
        listed = spark.read.text(path).select(F.trim("value").alias("listed")).filter("listed <> ''")
        folders = [r.folder for r in listed.select(F.regexp_replace("listed", r"/[^/]*$", "").alias("folder")).distinct().toLocalIterator()]
        files = _files(spark, folders, "*", False) if folders else None
        if files is None:
            # Some folder isn't there; one scan reads all that are.
            there = [f for f in folders if _files(spark, f, "*", False) is not None]
            files = _files(spark, there, "*", False) if there else None
        if files is None:
            return spark.createDataFrame([], "path string, length long")
        return files.join(listed, F.regexp_replace("path", "^file:", "") == F.regexp_replace("listed", "^file:", ""), "left_semi").orderBy("path")
    files = _files(spark, path, pattern, True)
    return files.orderBy("path")


def _files(spark: SparkSession, path: str | list[str], pattern: str, recursive: bool) -> DataFrame | None:
    if isinstance(path, str) and "." in path.rsplit("/", 1)[-1]:
        pattern = "*"
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path).select("path", "length")
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def split_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, folder, line: non-empty lines of list files, one sample each; the file's stem and the name of its folder."""
    folder = basename(F.regexp_replace(F.input_file_name(), r"/[^/]*$", ""))
    return spark.read.text(paths).select(stem(F.input_file_name()).alias("source"), folder.alias("folder"), F.trim("value").alias("line")).filter("line <> ''")


def category_objects(spark: SparkSession, root: str, stage: str, prefix: str = "softras_") -> DataFrame:
    """category, object, path: every object that the list ``<root>/<category>/<prefix><stage>.lst`` of a category names; categories without one have none."""
    found = _files(spark, root, f"{prefix}{stage}.lst", True)
    if found is None:
        return spark.createDataFrame([], "category string, object string, path string")
    lists = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}{stage}.lst").text(root)
    folder = F.regexp_replace(F.input_file_name(), r"/[^/]*$", "")
    lines = lists.select(basename(folder).alias("category"), F.trim("value").alias("object"), folder.alias("_f")).filter("object <> ''")
    return lines.select("category", "object", F.concat_ws("/", "_f", "object").alias("path"))


def view_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """category, object, views from lines ``category object v1 v2 ...``."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    return lines.select(parts[0].alias("category"), parts[1].alias("object"), F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda v: v.cast("int")).alias("views"))


def with_names(paths: DataFrame, column: str) -> DataFrame:
    return paths.withColumn("name", basename(F.col(column))).withColumn("stem", stem(F.col(column))).withColumn("suffix", suffix(F.col(column)))
