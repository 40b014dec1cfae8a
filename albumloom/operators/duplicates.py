"""Near-duplicate photos of one day: hash distance at most ``dup_max_bits`` and file names that are variants.

Rows with equal (day, stem, hash) collapse to one node first, so a mass of copies is one row. Nodes then meet
in buckets (day, name key, centre): the name key is a stem that exists that day, the centre is a hash at
distance at most one from the node's. Two hashes within distance two share a centre, and all hashes around
one centre are within distance two, so every bucket is exactly a set of matches around the owners of its key
and no pair list is ever built: groupings give the extremes, and a star to the first owner gives the edges.

That holds for distance two alone. At any other distance the distinct hashes under a name key are paired by
``hashindex``; the extremes are taken over the hashes near a node's own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumloom.functions.names import open_prefixes, stem
from albumloom.functions.hashes import packed
from albumloom.operators.components import components
from albumloom.operators.hashindex import pairs_within
from albumloom.params import Chunking
from albumloom.session import settle


def _nodes(photos: DataFrame) -> DataFrame:
    """One narrow row per distinct (day, stem, hash), written out once: the steps below read it several times."""
    return settle(
        photos.where("hash_hi IS NOT NULL AND hash_lo IS NOT NULL")
        .groupBy("day", stem(F.col("filename")).alias("stem"), "hash_hi", "hash_lo")
        .agg(F.min("photo_id").alias("node"), F.max("photo_id").alias("top"))
    )


def _centres(hi: Column, lo: Column, radius: Column) -> Column:
    one = F.lit(1).cast("bigint")
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", one, i))
    ball = F.concat(
        F.transform(flips, lambda f: F.struct(hi.bitwiseXOR(f).alias("hi"), lo.alias("lo"))),
        F.transform(flips, lambda f: F.struct(hi.alias("hi"), lo.bitwiseXOR(f).alias("lo"))),
    )
    own = F.array(F.struct(hi.alias("hi"), lo.alias("lo")))
    return F.when(radius == 1, F.concat(own, ball)).otherwise(own)


def _members(nodes: DataFrame) -> DataFrame:
    """(day, key, hashes, node, top, owner): each node under its own stem, which it owns, and under those that its stem goes on from."""
    stems = nodes.select("day", F.col("stem").alias("key")).distinct()
    longer = nodes.withColumn("key", F.explode(open_prefixes(F.col("stem")))).join(stems, ["day", "key"], "left_semi")
    cols = ["day", "key", "hash_hi", "hash_lo", "node", "top"]
    return (
        nodes.withColumn("key", F.col("stem")).select(*cols).withColumn("owner", F.lit(True))
        .unionAll(longer.select(*cols).withColumn("owner", F.lit(False)))
    )


def _buckets(nodes: DataFrame) -> DataFrame:
    """(day, key, c_hi, c_lo, node, top, owner): each node in each bucket it may share with others."""
    members = settle(_members(nodes))  # read twice
    # a node alone under its key has no match there; one hash under a key needs only its own centre
    spread = members.groupBy("day", "key").agg(
        ((F.min("hash_hi") != F.max("hash_hi")) | (F.min("hash_lo") != F.max("hash_lo"))).alias("varied"), F.count("*").alias("n")
    ).where("n > 1").select("day", "key", F.when(F.col("varied"), 1).otherwise(0).alias("radius"))
    placed = members.join(spread, ["day", "key"])
    centre = F.explode(_centres(F.col("hash_hi"), F.col("hash_lo"), F.col("radius"))).alias("c")
    return placed.select("day", "key", "node", "top", "owner", centre).select(
        "day", "key", F.col("c.hi").alias("c_hi"), F.col("c.lo").alias("c_lo"), "node", "top", "owner"
    )


def _met(nodes: DataFrame) -> DataFrame:
    """Bucket rows with the extremes of the bucket and of its owners."""
    rows = settle(_buckets(nodes))
    key = ["day", "key", "c_hi", "c_lo"]
    owners = F.when(F.col("owner"), F.col("node"))
    stats = rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.min(owners).alias("first_owner"),
        F.max(F.when(F.col("owner"), F.col("top"))).alias("last_owner"),
        F.min("node").alias("first_any"),
        F.max("top").alias("last_any"),
    ).where("n > 1 AND first_owner IS NOT NULL").drop("n")
    return rows.join(stats, key)


class Matches(NamedTuple):
    """What reach and groups both go by; ``named`` is the part that holds at any distance."""

    nodes: DataFrame
    met: DataFrame
    edges: DataFrame
    named: tuple[DataFrame, DataFrame] | None = None


ENDS = ("first_owner", "last_owner", "first_any", "last_any")


def _named(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with the extremes of those of their key and hash, the groups whose key has several hashes)."""
    at = ["day", "key", "h"]
    rows = settle(_members(nodes).withColumn("h", packed(F.col("hash_hi"), F.col("hash_lo"))).drop("hash_hi", "hash_lo"))
    own = {k: F.when(F.col("owner"), F.col(k)) for k in ("node", "top")}
    groups = settle(rows.groupBy(*at).agg(*[v.alias(k) for k, v in zip(ENDS, (F.min(own["node"]), F.max(own["top"]), F.min("node"), F.max("top")))]))
    varied = groups.groupBy("day", "key").agg(F.count("*").alias("n")).where("n > 1").select("day", "key")
    return settle(rows.join(groups, at)), settle(groups.join(varied, ["day", "key"], "left_semi"))


def _met_within(named: tuple[DataFrame, DataFrame], radius: int) -> tuple[DataFrame, DataFrame]:
    """(rows like those of ``_met``, edges) at any distance.

    Nodes of one key and hash are one group first; it has one owner at most, as an owner's stem is the key. Groups within
    the distance are paired. Of each pair the owner is an edge to the first node of the other group, and each
    node has an edge to the smallest owner near its hash.
    """
    at = ["day", "key", "h"]
    rows, varied = named
    pairs = pairs_within(varied, ["day", "key"], radius)
    near = settle(pairs.join(varied.withColumnRenamed("h", "other"), ["day", "key", "other"]))
    wide = near.groupBy(*at).agg(*[(F.min(k) if k.startswith("first") else F.max(k)).alias(f"near_{k}") for k in ENDS])
    ends = [(F.least if k.startswith("first") else F.greatest)(k, f"near_{k}").alias(k) for k in ENDS]
    met = settle(rows.join(wide, at, "left").select(*at, "node", "top", "owner", *ends).where("owner OR first_owner IS NOT NULL"))
    other = varied.select(*at, F.col("first_any").alias("a"))
    across = near.where("first_owner IS NOT NULL").join(other, at).select("a", F.col("first_owner").alias("b"))
    return met, across.unionByName(met.where("first_owner IS NOT NULL").select(F.col("node").alias("a"), F.col("first_owner").alias("b")))


def matches(photos: DataFrame, p: Chunking = Chunking(), like: Matches | None = None) -> Matches:
    """The matches that ``duplicate_reach`` and ``duplicate_groups`` of these photos take, worked out once for both.

    ``like`` are matches of the same photos at another distance; what does not hang on the distance is taken from there.
    """
    nodes = like.nodes if like else _nodes(photos)
    if p.dup_max_bits == 2:
        met = _met(nodes)
        return Matches(nodes, met, met.select(F.col("node").alias("a"), F.col("first_owner").alias("b")), like.named if like else None)
    named = like.named if like and like.named else _named(nodes)
    return Matches(nodes, *_met_within(named, p.dup_max_bits), named)


def duplicate_reach(photos: DataFrame, p: Chunking = Chunking(), found: Matches | None = None) -> DataFrame:
    """Photos with at least one near duplicate: smallest and largest id among themselves and their matches."""
    nodes, met, _, _ = found or matches(photos, p)
    low = F.when(F.col("owner"), F.col("first_any")).otherwise(F.col("first_owner"))
    high = F.when(F.col("owner"), F.col("last_any")).otherwise(F.col("last_owner"))
    far = met.groupBy("node").agg(F.min(low).alias("low"), F.max(high).alias("high"))
    reach = nodes.join(far, "node", "left").select(
        "day", "stem", "hash_hi", "hash_lo", F.least("node", "low").alias("first_match"), F.greatest("top", "high").alias("last_match")
    ).where("first_match != last_match")
    keyed = photos.select("photo_id", "day", stem(F.col("filename")).alias("stem"), "hash_hi", "hash_lo")
    return keyed.join(reach, ["day", "stem", "hash_hi", "hash_lo"]).select("photo_id", "first_match", "last_match")


def duplicate_groups(photos: DataFrame, p: Chunking = Chunking(), found: Matches | None = None) -> DataFrame:
    """All photos with ``group_id``, the smallest photo id of the duplicate group; photos without hash stay alone."""
    nodes, _, edges, _ = found or matches(photos, p)
    labels = components(edges).select(F.col("id").alias("node"), "component")
    group = nodes.join(labels, "node", "left").select("day", "stem", "hash_hi", "hash_lo", F.coalesce("component", "node").alias("group_id"))
    return (
        photos.withColumn("stem", stem(F.col("filename")))
        .join(group, ["day", "stem", "hash_hi", "hash_lo"], "left")
        .withColumn("group_id", F.coalesce("group_id", "photo_id"))
        .drop("stem")
    )


def keepers(grouped: DataFrame) -> DataFrame:
    """The kept photo of every group: largest file, then earliest; all photo columns."""
    cols = [c for c in grouped.columns if c != "group_id"]
    best = F.max_by(F.struct(*cols), F.struct("size_bytes", -F.col("t"), -F.col("photo_id"))).alias("p")
    return grouped.groupBy("group_id").agg(best).select("group_id", "p.*")


def dropped(grouped: DataFrame) -> DataFrame:
    """Rejected copies with the photo kept instead."""
    kept = keepers(grouped).select("group_id", F.col("photo_id").alias("kept_id"), F.col("filename").alias("kept_name"), F.col("path").alias("kept_file"))
    return (
        grouped.join(kept, "group_id")
        .where("photo_id != kept_id")
        .withColumn("reason", F.concat(F.lit("dup_of:"), "kept_name"))
        .drop("kept_name")
    )


def is_trash(p: Chunking = Chunking(), readable: Column | None = None, keep_all: bool = False) -> Column:
    """First failing metadata rule of a photo, null when it passes."""
    size, w, h = F.col("size_bytes"), F.col("width"), F.col("height")
    unreadable = ~readable if readable is not None else w.isNull() | h.isNull()
    if keep_all:
        return F.when(unreadable, "unreadable")
    return (
        F.when(size < p.min_size_bytes, "size_too_small")
        .when(unreadable, "unreadable")
        .when((w < p.min_side_px) | (h < p.min_side_px), "resolution_too_low")
        .when(F.greatest(w, h) / F.least(w, h) > p.max_aspect, "extreme_aspect_ratio")
    )
