"""File tables: what belongs to a library, digests, differences, nesting, equal content, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumloom.functions.names import basename, parent

# fixed values: folders not entered, picture endings, wallpaper prefix
SKIPPED_DIRS = [".thumbnails", "_FAILED_FOR_MANUAL_REVIEW", "@eaDir", "Thumbs.db", "$RECYCLE.BIN", "System Volume Information"]
PICTURE_ENDING = r"(?i)\.(jpg|jpeg|png)$"
WALLPAPER = r"(?i)^magazine-unlock-"


def clean_path(path: Column) -> Column:
    """One spelling per file: no doubled separators, no ``.`` parts."""
    return F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "/{2,}", "/")


def skipped_dir() -> str:
    names = "|".join(d.replace(".", r"\.").replace("$", r"\$") for d in SKIPPED_DIRS)
    return rf"/(\.[^/]*|{names})/"


def in_library(path: Column, root: Column) -> Column:
    """Whether it is a picture in no skipped folder; folders above and of the root itself do not count."""
    name = basename(path)
    top = F.concat(F.regexp_replace(clean_path(root), "/+$", ""), F.lit("/"))
    rest = F.when(F.startswith(path, top), F.substring(path, F.length(top), F.length(path))).otherwise(path)
    return name.rlike(PICTURE_ENDING) & ~name.rlike(WALLPAPER) & ~rest.rlike(skipped_dir())


def library_files(files: DataFrame) -> DataFrame:
    """Files (path, mtime, size and, where known, the root they were found under) -> library pictures, one row per real path."""
    root = F.col("root") if "root" in files.columns else F.lit("")
    kept = files.withColumn("path", clean_path(F.col("path"))).where(in_library(F.col("path"), root))
    return kept.groupBy("path").agg(F.min_by(F.struct("mtime", "size"), F.struct("mtime", "size")).alias("f")).select("path", "f.mtime", "f.size")


def snapshot(files: DataFrame) -> DataFrame:
    """One row that changes when any file is added, removed, renamed or changed; order-free, so every task adds its share."""
    row = F.md5(F.concat_ws("|", "path", F.col("mtime").cast("string"), F.col("size").cast("string")))
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")
    return files.agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.bit_xor(part), F.lit(0)).alias("mix"),
        F.coalesce(F.sum(part % 1000000007), F.lit(0)).alias("mark"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and changed files between two scans."""
    o = old.select("path", F.col("mtime").alias("o_mtime"), F.col("size").alias("o_size"))
    n = new.select("path", F.col("mtime").alias("n_mtime"), F.col("size").alias("n_size"))
    state = (
        F.when(F.col("o_size").isNull(), "added")
        .when(F.col("n_size").isNull(), "removed")
        .when((F.col("o_mtime") != F.col("n_mtime")) | (F.col("o_size") != F.col("n_size")), "changed")
    )
    return o.join(n, "path", "full").select("path", state.alias("state")).where("state IS NOT NULL")


def ancestors(path: Column) -> Column:
    """All proper ancestor folders, nearest last, without the top."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def nested_roots(roots: DataFrame) -> DataFrame:
    """(parent, child) for every root that lies inside another: each root's ancestors meet the roots in an equi-join."""
    distinct = roots.select("root").distinct()
    up = distinct.select(F.col("root").alias("child"), F.explode(ancestors(F.col("root"))).alias("parent"))
    return up.join(distinct.select(F.col("root").alias("parent")), "parent", "left_semi").select("parent", "child")


def cleanup_plan(files: DataFrame) -> DataFrame:
    """Wallpaper files to remove and the folders that stand empty afterwards (all levels below the top)."""
    rows = files.select("path", basename(F.col("path")).rlike(WALLPAPER).alias("gone"))
    dirs = (
        rows.select(F.explode(ancestors(F.col("path"))).alias("path"), "gone")
        .groupBy("path")
        .agg(F.count_if(~F.col("gone")).alias("left"))
        .where("left = 0")
    )
    return rows.where("gone").select("path", F.lit("file").alias("kind")).unionByName(dirs.select("path", F.lit("dir").alias("kind")))


def same_content(items: DataFrame) -> DataFrame:
    """(item_id, length, content) -> items whose content occurs again, with the first such item.

    Lengths that occur once are dropped before any content is hashed.
    """
    repeated = items.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    hashed = items.join(repeated, "length", "left_semi").select("item_id", "length", F.md5("content").alias("digest"))
    groups = hashed.groupBy("length", "digest").agg(F.min("item_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return hashed.join(groups, ["length", "digest"]).select("item_id", "first_id", "copies")


def first_file_named(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted names with the first file of that name in path order, null when there is none."""
    named = files.select(basename(F.col("path")).alias("name"), "path")
    first = named.join(wanted.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min("path").alias("path"))
    return wanted.join(first, "name", "left")


def parent_dirs(files: DataFrame) -> DataFrame:
    return files.select(parent(F.col("path")).alias("root")).distinct()
