"""Removal lists as text: one entry ``name|value`` per line, with an optional header that names the mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: header lines
HEADER = "#MATCH_MODE="
TIME_MODE, SIZE_MODE = "DATETIME", "SIZE"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): text lines with an order inside their file, split or not."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        F.col("value").alias("line"),
    )


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def list_modes(lines: DataFrame) -> DataFrame:
    """(file, mode): by the first line's header, else by the size of the first entry's value."""
    text = _trimmed(F.col("line"))
    data = (text != "") & ~F.startswith(text, F.lit("#")) & F.contains("line", F.lit("|"))
    fields = F.split("line", r"\|")
    value = F.when(F.size(fields) == 2, _trimmed(F.get(fields, F.lit(1))).try_cast("bigint"))
    per = lines.groupBy("file").agg(F.min_by(text, "at").alias("head"), F.min_by(F.struct(value.alias("v")), F.when(data, F.col("at"))).alias("first"))
    return per.select(
        "file",
        F.when(F.col("head") == HEADER + TIME_MODE, TIME_MODE).when(F.col("head") == HEADER + SIZE_MODE, SIZE_MODE)
        .when(F.coalesce(F.col("first.v"), F.lit(0)) > 1000000000, TIME_MODE).otherwise(SIZE_MODE).alias("mode"),
    )


def list_entries(lines: DataFrame) -> DataFrame:
    """(file, at, name, value): lines with exactly two fields; a value that is no number becomes -1."""
    text = _trimmed(F.col("line"))
    fields = F.split(text, r"\|")
    value = F.coalesce(_trimmed(F.get(fields, F.lit(1))).try_cast("bigint"), F.lit(-1))
    kept = lines.where((text != "") & ~F.startswith(text, F.lit("#")) & (F.size(fields) == 2))
    return kept.select("file", "at", _trimmed(F.get(fields, F.lit(0))).alias("name"), value.alias("value")).where("name != ''")


def parsed_list(lines: DataFrame) -> DataFrame:
    """Entries with their file's mode: ``size`` in bytes or ``taken_ms``, -1 when unknown."""
    e = list_entries(lines).join(list_modes(lines), "file")
    timed = F.col("mode") == TIME_MODE
    return e.select(
        "file", "at", "mode", "name", F.when(timed, -1).otherwise(F.col("value")).alias("size"),
        F.when(timed & (F.col("value") > 0), F.col("value") * 1000).otherwise(-1).alias("taken_ms"),
    )


def removal_text(entries: DataFrame) -> DataFrame:
    """Lines of a time-mode list, the header as one more row."""
    head = entries.sparkSession.createDataFrame([(HEADER + TIME_MODE,)], "line string")
    return head.unionByName(entries.select(F.concat("name", F.lit("|"), F.col("epoch").cast("string")).alias("line")))


def write_removal_list(entries: DataFrame, path: str, parts: int | None = None) -> None:
    """The entries by name and time in files of ascending ranges, each under its own header, so each is a list by itself.

    ``parts`` is the number of files at most, 1 for a phone; else Spark chooses it by size. Without entries there is
    one file with the header alone.
    """
    rows = entries.select(F.lit(1).alias("k"), "name", "epoch").unionByName(
        entries.sparkSession.createDataFrame([(0, "", 0)], "k int, name string, epoch bigint")
    )
    order = ["k", "name", "epoch"]
    rows = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    # the row number inside a part is what the lower 33 bits hold
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    head = F.lit(HEADER + TIME_MODE)
    line = F.concat("name", F.lit("|"), F.col("epoch").cast("string"))
    lines = rows.select("k", line.alias("line"), first.alias("first"))
    held = F.when(F.col("k") == 0, F.array(head)).when(F.col("first"), F.array(head, "line")).otherwise(F.array("line"))
    lines.select(F.explode(held).alias("value")).write.mode("overwrite").text(path)
