"""A training corpus from raw documents in five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.llm import decontam, mixing, neardup, quality, sharding
from albumloom.llm.common import shared_folder, stored, table

#: SQL cannot express the stages
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of this folder.

    Every row is judged by its text, null and empty ones too; equal rows fare alike; no rows give no rows.
    """
    return quality.judged(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Of rows that repeat an id the first by the hash of the text, then by columns, stays. Rows without an id are in no
    group and stay, as do documents without words. No rows give no rows.
    """
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    first = F.min(F.struct(F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("row"))).alias("first")
    named = kept.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(first).select("first.row.*")
    return named.unionByName(kept.where("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Only the text decides, so rows without an id, and rows that repeat one, are judged each by their own; null and
    empty texts hold nothing and stay. No rows give no rows.
    """
    text = F.md5(docs["text"].cast("binary"))
    found = decontam.contaminated(docs.select(text.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found.hint("shuffle_hash"), text == found["doc_id"], "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of a row as epochs of the mix take from it; whole documents, rows not taken go.

    Rows are numbered in a stored table first, so that each gets what the mix takes from it, also where ids are null
    or repeated and texts equal. Null texts and texts without words are not taken. No rows give no rows.
    """
    row = "_row"
    while any(c.startswith(row) for c in docs.columns):
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    takes = mixing.mix(numbered, row=row).where("epochs > 0").select(row, F.col("epochs").cast("int").alias(f"{row}epochs"))
    out = numbered.join(takes.hint("shuffle_hash"), row)
    return out.withColumn(f"{row}copy", F.explode(F.sequence(F.lit(1), F.col(f"{row}epochs")))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; null ids and texts are rows like others. No rows give no rows."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    top = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{top}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
