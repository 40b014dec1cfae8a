"""Pairs of 64-bit hashes within any distance, by multi-index hashing.

Cut the 64 bits into radius + 1 bands in any way: two hashes that differ in at most ``radius`` bits agree in one band at
least. So they meet in a bucket of a band and its value. A bucket that is still crowded is dealt again by another cut
of the bits, which the same two hashes share a band of as well: no pair is lost. What is crowded after some cuts agrees
in so many bits that most of its pairs are near; it is dealt into blocks, and each two blocks meet on their own.
So no group above the limit is ever joined with itself.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumloom.session import settle

#: members up to which a bucket is joined with itself
CROWD = 64
#: cuts of the bits before blocks
LEVELS = 2


def band_masks(radius: int, level: int) -> list[int]:
    """radius + 1 masks that share out the 64 bits: neighbouring bits first, then in an order of each level's own."""
    bits = list(range(64))
    if level:
        random.Random(level).shuffle(bits)
    n = radius + 1
    masks = [sum(1 << b for b in bits[64 * k // n : 64 * (k + 1) // n]) for k in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pairs_within(rows: DataFrame, by: list[str], radius: int, crowd: int = CROWD) -> DataFrame:
    """(by..., h) with distinct h inside ``by`` -> (by..., h, other): both orders of each pair at ``radius`` or less, no h with itself.

    Beyond 63 every pair qualifies and there is no band; the radius must lie below.
    """
    if not 0 <= radius < 64:
        raise ValueError("radius must lie between 0 and 63")
    found: list[DataFrame] = []
    open_ = settle(rows.select(*by, "h", F.xxhash64(*by).alias("bucket")))
    for level in range(LEVELS + 1):
        sizes = settle(open_.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        held = open_.join(sizes, "bucket")
        found.append(_met(held.where(F.col("n") <= crowd), by, radius))
        dense = held.where(F.col("n") > crowd)
        if sizes.where(F.col("n") > crowd).isEmpty():
            break
        if level == LEVELS:
            blocks = F.ceil(F.col("n") * 2 / crowd)
            own = F.pmod(F.xxhash64("h"), blocks)
            cells = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda o: F.xxhash64("bucket", F.least(o, own), F.greatest(o, own)))
            found.append(_met(settle(dense.select(*by, "h", F.explode(cells).alias("bucket"))), by, radius))
            break
        masks = F.array(*[F.lit(m).cast("bigint") for m in band_masks(radius, level)])
        dealt = dense.select(*by, "h", "bucket", F.posexplode(masks).alias("band", "mask"))
        open_ = settle(dealt.select(*by, "h", F.xxhash64(F.col("bucket"), F.lit(level), F.col("band"), F.col("h").bitwiseAND(F.col("mask"))).alias("bucket")))
    once = settle(reduce(DataFrame.unionByName, found).distinct())
    return once.unionByName(once.select(*by, F.col("other").alias("h"), F.col("h").alias("other")))


def _met(members: DataFrame, by: list[str], radius: int) -> DataFrame:
    """Pairs (h < other) within the buckets that are near enough; a bucket may hold rows of several keys."""
    other = members.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("h").alias("other"), "bucket")
    met = members.join(other, "bucket").where((F.col("h") < F.col("other")) & (distance(F.col("h"), F.col("other")) <= radius))
    for c in by:
        met = met.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    return met.select(*by, "h", "other")
