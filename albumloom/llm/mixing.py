"""Mixing sources to target weights: hash-random order within each source, spread prefix sums, exact cut of budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumloom.llm.common import spread_sums, stored

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(gk, source_size) -> with target: ``share`` of all sizes dealt by weight, none above ``most`` times its size.

    Weights go round by the order of gk. The level at which all targets min(weight * level, most * size) share the
    whole is found by sorting on most * size / weight: the sources before some point are full, the others share the
    rest. One row per source.
    """
    by_name = Window.orderBy("gk")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rated = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    up = Window.orderBy("full_at", "gk").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("full_at", "gk").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(rest)
    # the level is the first one that the source after it does not fill up under
    first = rated.withColumn("level", level).withColumn("held", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "gk", "level"))).over(everything))
    return first.select("gk", "source_size", F.when(F.col("held").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("held.level"))).alias("target"))


def mix_key(docs: DataFrame, seed: int = 7) -> Column:
    """The hash that puts a source's documents in order."""
    return F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 7, row: str | None = None) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target, taken, epochs.

    ``row`` names a column that tells rows apart; it is handed on. Which of some equal rows the cut falls on goes by it.

    Size counts words. Sources are weighed in code-point order, null last and a source like any other. Each source's
    documents are put in the order of a hash of seed, id and text; whole epochs are taken first, then documents in
    that order until the budget (the target, rounded) is met to the word: the document at the cut gives the words
    that are still needed. ``epochs`` is the number of times that some of the document is taken. Null texts have size
    0 and are never taken; an empty table gives no rows; repeated rows are rows of their own; other columns are
    not read. Reruns agree.
    """
    own = [] if row is None else [row]
    kept = docs.select(
        *own,
        "doc_id",
        "source",
        # '=' keeps the code-point order and sorts before '>', which stands for null
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(">")).alias("gk"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        mix_key(docs, seed).alias("key"),
    )
    kept = stored(kept, "sizes")
    targets = source_targets(kept.groupBy("gk").agg(F.sum("size").alias("source_size")), weights, share, most)
    placed = spread_sums(kept, ["gk"], "key", ["doc_id", "size", *own], {"before": F.col("size")}).join(targets, "gk")
    budget = F.round("target").cast("bigint")
    full = F.when(F.col("source_size") > 0, F.expr("cast(round(target) AS bigint) div source_size")).otherwise(F.lit(0).cast("bigint"))
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), budget - full * F.col("source_size") - F.col("before")))
    return placed.select(
        *own,
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (full * F.col("size") + part).alias("taken"),
        F.when(F.col("size") > 0, full + (part > 0).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("epochs"),
        "key",
    )
