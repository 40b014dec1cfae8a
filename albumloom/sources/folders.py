"""Event folders ``YYYY-MM-DD-name`` read off file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumloom.functions.names import basename
from albumloom.operators.files import PICTURE_ENDING, SKIPPED_DIRS

# fixed value: event folder name
EVENT = r"^(\d{4}-\d{2}-\d{2})-(.+)$"


def _below(path: Column, root: str, level: int) -> Column:
    return F.get(F.split(F.substr(path, F.lit(len(root) + 2)), "/"), F.lit(level))


def event_photos(files: DataFrame, root: str) -> DataFrame:
    """(day, tag, event_name, path) of every picture below an event folder."""
    top = _below(F.col("path"), root, 0)
    rows = files.select("path", top.alias("tag")).where(F.col("tag").rlike(EVENT) & basename(F.col("path")).rlike(PICTURE_ENDING))
    return rows.select(F.substring("tag", 1, 10).alias("day"), "tag", F.regexp_extract("tag", EVENT, 2).alias("event_name"), "path")


def flat_events(files: DataFrame, root: str) -> DataFrame:
    """One row per event folder: picture count, first and last picture, whether a manifest lies in it."""
    f = files.select("path", _below(F.col("path"), root, 0).alias("tag")).where(F.col("tag").rlike(EVENT))
    pic = F.when(basename(F.col("path")).rlike(PICTURE_ENDING), F.col("path"))
    direct = F.col("path") == F.concat(F.lit(root + "/"), "tag", F.lit("/manifest.json"))
    return f.groupBy("tag").agg(
        F.count(pic).alias("photo_count"), F.min(pic).alias("first_photo"), F.max(pic).alias("last_photo"), F.bool_or(direct).alias("has_manifest")
    ).withColumns({"day": F.substring("tag", 1, 10), "event_name": F.regexp_extract("tag", EVENT, 2)})


def layered_events(files: DataFrame) -> DataFrame:
    """(root, path) -> events of either layout, one row each.

    A root with event folders on top is flat; only a root without any is searched one level down, where groups
    starting with a dot or underscore are passed over. Of equal tags the first group's stays, others get the
    group in front.
    """
    parts = F.split(F.expr("substring(path, length(root) + 2)"), "/")
    rows = files.select("root", F.get(parts, F.lit(0)).alias("d1"), F.get(parts, F.lit(1)).alias("d2"), basename(F.col("path")).rlike(PICTURE_ENDING).alias("pic"))
    dirs = rows.groupBy("root", "d1", "d2").agg(F.count_if("pic").alias("n"))
    flat = dirs.where(F.col("d1").rlike(EVENT)).groupBy("root", F.col("d1").alias("name")).agg(F.sum("n").alias("photo_count"))
    layout = flat.select("root").distinct()
    nested = (
        dirs.where(F.col("d2").rlike(EVENT) & ~F.col("d1").rlike(r"^[._]"))
        .join(layout, "root", "left_anti")
        .groupBy("root", F.col("d1").alias("grp"), F.col("d2").alias("name"))
        .agg(F.sum("n").alias("photo_count"))
    )
    first = nested.groupBy("root", "name").agg(F.min("grp").alias("first_grp"))
    nested = nested.join(first, ["root", "name"])
    tag = F.when(F.col("grp") == F.col("first_grp"), F.col("name")).otherwise(F.concat("grp", F.lit("_"), "name"))
    both = flat.select("root", F.lit(None).cast("string").alias("grp"), F.col("name").alias("tag"), "name", "photo_count").unionByName(
        nested.select("root", "grp", tag.alias("tag"), "name", "photo_count")
    )
    return both.select("root", "grp", "tag", F.substring("name", 1, 10).alias("day"), F.substring("name", 1, 4).alias("year"), F.regexp_extract("name", EVENT, 2).alias("event_name"), "photo_count")


def _skip() -> Column:
    return F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def archive_photos(files: DataFrame, root: str) -> DataFrame:
    """(year, month, day, path) of every picture in dated folders, system folders left out."""
    p = event_photos(files.where(~_skip()), root)
    return p.select(F.substring("day", 1, 4).alias("year"), F.substring("day", 6, 2).alias("month"), "day", "path")


def odd_folders(files: DataFrame, root: str) -> DataFrame:
    """Top folders whose names are no dated events, system folders left out."""
    top = files.where(~_skip()).select(_below(F.col("path"), root, 0).alias("folder")).distinct()
    return top.where(~F.col("folder").rlike(EVENT))
