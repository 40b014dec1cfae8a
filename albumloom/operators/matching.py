"""Removal list against a gallery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumloom.params import Matching


def _first_entries(entries: DataFrame) -> DataFrame:
    """Only the first entry of a name is ever tried."""
    return entries.groupBy("name").agg(F.min_by(F.struct("size", "taken_ms"), "at").alias("e")).select(
        "name", F.col("e.size").alias("want_size"), F.col("e.taken_ms").alias("want_ms")
    )


def match_by_time(gallery: DataFrame, entries: DataFrame, p: Matching = Matching()) -> DataFrame:
    """Gallery items whose name is listed and whose time lies within the tolerance; an entry without time matches by
    name alone. ``warning`` marks matches more than two seconds off."""
    off = F.abs(F.col("taken_ms") - F.col("want_ms"))
    timed = F.col("want_ms") > 0
    rows = gallery.join(_first_entries(entries), "name").where(~timed | (off < p.time_tolerance_ms))
    return rows.select("item_id", "name", "taken_ms", "size", (timed & (off > p.warn_after_ms)).alias("warning"))


def match_by_size(gallery: DataFrame, entries: DataFrame, p: Matching = Matching()) -> DataFrame:
    """Gallery items whose name is listed and whose size lies within the tolerance, or unknown in the list."""
    near = (F.col("want_size") == -1) | (F.abs(F.col("size") - F.col("want_size")) < p.size_tolerance)
    return gallery.join(_first_entries(entries), "name").where(near).select("item_id", "name", "taken_ms", "size", F.lit(False).alias("warning"))


def still_present(matched: DataFrame, gallery: DataFrame) -> DataFrame:
    return matched.join(gallery.select("item_id"), "item_id", "left_semi")


def result_counts(lines: DataFrame, photos: DataFrame) -> DataFrame:
    """Photos to delete (data lines of the list) and to keep."""
    total = photos.agg(F.count("*")).scalar()
    d = lines.agg(F.count_if((F.trim("line") != "") & ~F.startswith("line", F.lit("#"))).alias("delete_count"))
    return d.select("delete_count", F.greatest(F.lit(0), total - F.col("delete_count")).alias("keep_count"))
