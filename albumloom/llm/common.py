"""What several operators share: stored intermediates, spread prefix sums, connected components, Arrow text batches."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: slices per shuffle partition; so many even out what hashing deals to a partition
SLICES = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, else the one the application has set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named.rstrip("/")


_folders: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs a re-read.

    All tables of an application lie in one folder, which goes when the Python driver ends.
    """
    spark = df.sparkSession
    top = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if top not in _folders:
        _folders.add(top)
        atexit.register(_remove, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_sums(df: DataFrame, by: list[str], key: str, ties: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name in ``values``, the sum over the rows before this one in (key, ties) order within ``by``.

    ``key`` is a uniform 64-bit hash. Its leading bits range-partition every group into slices, so that a group of any
    share of the rows is sorted and summed by many tasks; one row per slice carries the offsets. ``by`` has no nulls.
    ``df`` is read twice and should be a stored table.
    """
    n = partitions(df.sparkSession) * SLICES
    # the leading 31 bits, as a signed order would put negative keys first
    lead = F.shiftrightunsigned(F.col(key), 33)
    cut = df.withColumn("_slice", F.shiftright(lead * n, 31))
    held = {f"_v{i}": v for i, v in enumerate(values.values())}
    sums = cut.groupBy(*by, "_slice").agg(*[F.sum(v).alias(k) for k, v in held.items()])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_slice", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}o") for k in held])
    inside = Window.partitionBy(*by, "_slice").orderBy(lead, key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(offsets, [*by, "_slice"])
    for (k, v), name in zip(held.items(), values):
        out = out.withColumn(name, F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"{k}o"))
    return out.drop("_slice", *[f"{k}o" for k in held])


def star_links(edges: DataFrame) -> DataFrame:
    """(a, b) links of ids -> stored (a, b): every id with links that is not the smallest reachable, and that smallest id.

    Large-star and small-star rounds by grouped minima and equi-joins; it ends when every id with links points to
    one that points nowhere, whatever number of rounds that takes. No neighbour list is collected.
    """
    links = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # done when no target points on and no id has two targets; one grouping tells both
        ends = links.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.unionByName(links.select(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if not ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").count():
            return links
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # one row for each link at most, so that what repeats can wait for the distinct below
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of ids -> (id, component), the smallest id reachable; ids without links are left out."""
    links = star_links(edges)
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def hash_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (all where there are fewer), chosen by the hash of doc_id.

    The same documents are chosen whatever the order or partitioning of the input. ``by`` has few values.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(min(1.0, most / n))).otherwise(share)
    spot = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    return rows.where(spot < share)


def held_out(k: int, remainder: int) -> Column:
    """True where crc32 of doc_id as text has this remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % k == remainder, F.lit(False))


def pinned(value: Column) -> Column:
    """``value``, worked out once per row: the optimizer copies no expression with a row number into others.

    Without it a filter on what a lambda makes of an array column would work the array out again for each element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
