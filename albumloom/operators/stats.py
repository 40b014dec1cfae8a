"""Small reports over counts, rates and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumloom.session import settle

# fixed values: the eight distance bins
DISTANCE_BINS = [(0, 5), (6, 10), (11, 15), (16, 20), (21, 25), (26, 30), (31, 40), (41, 64)]


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """Count and share per bin; empty bins stay. Counts are one aggregate row, so nothing but that row moves."""
    counts = df.agg(*[F.count_if(value.between(lo, hi)).alias(f"{lo}-{hi}") for lo, hi in DISTANCE_BINS])
    total = sum((F.col(f"`{lo}-{hi}`") for lo, hi in DISTANCE_BINS), F.lit(0))
    bins = F.array(*[F.struct(F.lit(f"{lo}-{hi}").alias("bin"), F.col(f"`{lo}-{hi}`").alias("n")) for lo, hi in DISTANCE_BINS])
    return counts.select(total.alias("total"), F.explode(bins).alias("b")).select(
        "b.bin", "b.n", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("b.n") * 100.0 / F.col("total"), 4)).alias("pct")
    )


def batch_sizes(batched: DataFrame) -> DataFrame:
    """Batch count per size, with the overall count, range and mean on each row."""
    # a handful of rows that five parts of the result read
    per = settle(batched.groupBy("day", "batch_no").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("batches")))
    mean = F.round(F.sum(F.col("size") * F.col("batches")) / F.sum("batches"), 4)
    whole = {"all_batches": F.sum("batches"), "min_size": F.min("size"), "max_size": F.max("size"), "avg_size": mean}
    return per.select("*", *[per.agg(a).scalar().alias(n) for n, a in whole.items()])
