"""File listings of picture libraries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.operators.files import library_files


def list_files(spark: SparkSession, roots: str) -> DataFrame:
    """(path, mtime, size, root) of all files below ``;``-separated roots; file contents are never read."""
    def one(root: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return found.select(
            F.regexp_replace("path", "^file:/*", "/").alias("path"), F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"),
            F.regexp_replace(F.lit(root), "^file:/*", "/").alias("root"),
        )

    parts = [r.strip() for r in roots.split(";") if r.strip()]
    return reduce(DataFrame.unionByName, [one(r) for r in parts])


def scan_library(spark: SparkSession, roots: str) -> DataFrame:
    """Library pictures of all roots, one row per real path."""
    return library_files(list_files(spark, roots))


def date_range(gallery: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Items taken within the bounds (both included), oldest first; the bounds reach the scan."""
    return gallery.where(F.col("taken_ms").between(start_ms, end_ms)).orderBy("taken_ms", "item_id")
