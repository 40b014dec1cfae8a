"""Cutting a day into segments by time gap and hash distance, and merging look-alike segments into events.

Photos of one second never part (the gap is 0), so a day is first summed up to one row per second: at most
86,400 rows a day however many photos it has. Every per-day window below runs on those rows. A cut needs a
gap of ``burst_seconds``, so a day has at most 86,400 / burst_seconds + 1 segments.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumloom.functions.hashes import hamming, packed, unpacked
from albumloom.params import Chunking


def second_marks(photos: DataFrame) -> DataFrame:
    """One row per (day, second): count, first and last photo's hash, first hash present."""
    bits = packed(F.col("hash_hi"), F.col("hash_lo"))
    return photos.groupBy("day", "t").agg(
        F.count("*").alias("n"),
        F.min_by(bits, "photo_id").alias("head"),
        F.max_by(bits, "photo_id").alias("tail"),
        F.min_by(bits, F.when(bits.isNotNull(), F.col("photo_id"))).alias("rep"),
    )


def gaps(marks: DataFrame) -> DataFrame:
    """Marks with the gap to the second before and the hash distance over that gap."""
    w = Window.partitionBy("day").orderBy("t")
    return marks.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("before", F.lag("tail").over(w)).withColumn(
        "dist", F.bit_count(F.col("before").bitwiseXOR(F.col("head")))
    )


def segment_marks(photos: DataFrame, p: Chunking = Chunking()) -> DataFrame:
    """Marks with ``segment``, numbered from 0 inside the day."""
    cut = (
        F.when(F.col("gap") < p.burst_seconds, 0)
        .when(F.col("gap") > p.hard_cut_seconds, 1)
        .when(F.col("dist") > p.segment_max_bits, 1)
        .otherwise(0)
    )
    w = Window.partitionBy("day").orderBy("t")
    return gaps(second_marks(photos)).withColumn("segment", F.sum(cut).over(w))


def middle_gaps(photos: DataFrame, p: Chunking = Chunking()) -> DataFrame:
    """Neighbours whose gap lies between burst and hard cut and whose hashes are both there."""
    return gaps(second_marks(photos)).where(
        (F.col("gap") >= p.burst_seconds) & (F.col("gap") <= p.hard_cut_seconds) & F.col("dist").isNotNull()
    )


def segments(marks: DataFrame) -> DataFrame:
    """One row per segment: time range, photo count, first hash present."""
    hi, lo = unpacked(F.col("rep"))
    return marks.groupBy("day", "segment").agg(
        F.min("t").alias("start_t"),
        F.max("t").alias("end_t"),
        F.sum("n").alias("n"),
        F.min_by("rep", F.when(F.col("rep").isNotNull(), F.col("t"))).alias("rep"),
    ).select("day", "segment", "start_t", "end_t", "n", hi.alias("hash_hi"), lo.alias("hash_lo"))


def similar_segments(segs: DataFrame, p: Chunking = Chunking()) -> DataFrame:
    """Pairs (first, second) of one day that look alike and lie within the span.

    Equi-join on time buckets as wide as the span. A bucket holds at most span / burst + 1 segments.
    """
    width = p.merge_span_seconds
    s = segs.where("hash_hi IS NOT NULL").withColumn("bucket", F.floor(F.col("start_t") / width))
    a = s.select("day", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), F.col("segment").alias("first"),
                 F.col("start_t").alias("a_start"), F.col("hash_hi").alias("a_hi"), F.col("hash_lo").alias("a_lo"))
    b = s.select("day", "bucket", F.col("segment").alias("second"), F.col("end_t").alias("b_end"), F.col("hash_hi").alias("b_hi"), F.col("hash_lo").alias("b_lo"))
    return a.join(b, ["day", "bucket"]).where(
        (F.col("first") < F.col("second"))
        & (F.col("b_end") - F.col("a_start") <= width)
        & (hamming(F.col("a_hi"), F.col("a_lo"), F.col("b_hi"), F.col("b_lo")) <= p.merge_max_bits)
    ).select("day", "first", "second")


def _join_chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest segment reachable from each segment of one day."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(pdf["first"], pdf["second"]):
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    seen = sorted(root)
    return pd.DataFrame({"day": pdf["day"].iloc[0], "segment": seen, "event": [find(x) for x in seen]})


def event_marks(photos: DataFrame, p: Chunking = Chunking()) -> DataFrame:
    """(day, t) -> segment and event; the event is the first segment of the merged group.

    The grouped step sees one day's similar pairs, bounded as said above.
    """
    marks = segment_marks(photos, p)
    pairs = similar_segments(segments(marks), p)
    merged = pairs.groupBy("day").applyInPandas(_join_chains, "day date, segment bigint, event bigint")
    return marks.select("day", "t", "n", "segment").join(merged, ["day", "segment"], "left").withColumn("event", F.coalesce("event", "segment"))


def with_events(photos: DataFrame, p: Chunking = Chunking()) -> DataFrame:
    """Photos with their segment and event."""
    return photos.join(event_marks(photos, p).select("day", "t", "segment", "event"), ["day", "t"])
