"""Row positions and carried values in a total order, without gathering a whole key in one task.

``row_number``/``lag`` over a key put all its rows in one task. Here the rows are range-partitioned on
(key, order), numbered inside their slice, and one summary row per (slice, key) carries counts and last
values over the slice edges, so the largest key is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumloom.session import settle

BLOCK = 65536


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Add ``pos`` (0-based inside the key) and ``prev_<c>`` for each carried column.

    ``order`` must be unique inside a key, else ties come out in any order.
    """
    sort = [*keys, *order]
    rows = settle(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_at", 33))
    part = [F.col("_slice"), *[F.col(k) for k in keys]]
    ends = rows.groupBy("_slice", *keys).agg(
        F.min("_at").alias("_lo"),
        F.count("*").alias("_n"),
        F.max_by(F.struct(F.col("_at"), *[F.col(c) for c in carry]), "_at").alias("_last"),
    )
    # one row per (slice, key): at most as many per key as there are slices
    over_slices = Window.partitionBy(*keys).orderBy("_slice") if keys else Window.partitionBy(F.lit(0)).orderBy("_slice")
    ends = ends.select(
        "_slice",
        *keys,
        "_lo",
        F.coalesce(F.sum("_n").over(over_slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_last").over(over_slices).alias("_edge"),
    )
    here = Window.partitionBy(*part).orderBy("_at")
    for c in carry:
        rows = rows.withColumn(f"_lag_{c}", F.lag(c).over(here))
    out = rows.join(ends, ["_slice", *keys])
    first = F.col("_at") == F.col("_lo")
    return out.select(
        *[c for c in df.columns],
        (F.col("_at") - F.col("_lo") + F.col("_before")).alias("pos"),
        *[F.when(first, F.col(f"_edge.{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}") for c in carry],
    )


def running_max(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], upto_current: bool = True) -> DataFrame:
    """Largest value so far by ``pos`` inside a key, null while there is none."""
    return _running(rows, keys, values, upto_current, F.max, F.greatest)


def running_sum(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], upto_current: bool = True) -> DataFrame:
    """Sum so far by ``pos`` inside a key, 0 while there is none."""
    return _running(rows, keys, values, upto_current, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def _running(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], upto_current: bool, agg: Callable, both: Callable) -> DataFrame:
    """Running aggregates in blocks of positions, joined by one summary row per block."""
    rows = rows.withColumn("_blk", F.floor(F.col("pos") / BLOCK))
    for name, value in values.items():
        rows = rows.withColumn(f"_v_{name}", value)
    end = 0 if upto_current else -1
    inside = Window.partitionBy(*keys, "_blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "_blk").agg(*[agg(f"_v_{n}").alias(f"_m_{n}") for n in values])
    blocks = blocks.select(*keys, "_blk", *[agg(f"_m_{n}").over(before).alias(f"_p_{n}") for n in values])
    rows = rows.select("*", *[agg(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in values]).join(blocks, [*keys, "_blk"])
    for n in values:
        rows = rows.withColumn(n, both(F.col(f"_i_{n}"), F.col(f"_p_{n}")))
    return rows.drop("_blk", *[f"{p}{n}" for n in values for p in ("_v_", "_i_", "_p_")])
