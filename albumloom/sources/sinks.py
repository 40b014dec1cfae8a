"""Documents written for people and for the next stage: one table per list, one summary row, JSON where asked."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.functions.times import from_seconds
from albumloom.params import Chunking

BATCH_SCHEMA = (
    "date string, batch_id string, size bigint, photos array<struct<file: string, filename: string, datetime: string, is_exact_time: boolean, "
    "gps: array<double>, gps_text: string, gps_strong: string>>"
)


def batch_rows(batched: DataFrame) -> DataFrame:
    """Batched photos -> one row per batch with its photos in order (at most a batch's worth each)."""
    photo = F.struct(
        F.col("path").alias("file"), "filename", F.date_format(from_seconds(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.col("is_exact").alias("is_exact_time"),
        F.when(F.col("lat").isNotNull(), F.array("lat", "lng")).alias("gps"), F.lit(None).cast("string").alias("gps_text"), F.lit(None).cast("string").alias("gps_strong"),
    )
    got = F.array_sort(F.collect_list(F.struct("rank", photo.alias("photo"))))
    return batched.groupBy("day", "batch_id").agg(F.count("*").alias("size"), got.alias("got")).select(
        F.col("day").cast("string").alias("date"), "batch_id", "size", F.transform("got", lambda g: g["photo"]).alias("photos")
    )


def document_summary(scanned: DataFrame, kept: DataFrame, trashed: DataFrame, deduped: DataFrame, batches: DataFrame) -> DataFrame:
    """One row of totals."""
    counts = {"kept": kept, "trashed": trashed, "deduped": deduped, "batch_count": batches}
    out = scanned.agg(F.count("*").alias("total_scanned"))
    return out.select("*", *[df.agg(F.count("*")).scalar().alias(name) for name, df in counts.items()])


def document_header(p: Chunking, summary: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row: run parameters, totals, and the snapshot that a resumed run holds against its source."""
    settings = F.struct(*[F.lit(v).alias(k) for k, v in asdict(p).items()])
    source = snapshot.select(F.struct("*")).scalar()
    return summary.select(settings.alias("params"), F.struct("*").alias("summary"), source.alias("source_dir_snapshot"))


HEADER_SCHEMA = "params map<string, string>, summary map<string, bigint>, source_dir_snapshot map<string, bigint>"


def write_batch_document(out: str, batches: DataFrame, trashed: DataFrame, deduped: DataFrame, summary: DataFrame, header: DataFrame | None = None) -> None:
    """Batches as JSON, one document per batch; rejected and duplicate rows and the totals as parquet; the header as one JSON line."""
    if header is not None:
        header.write.mode("overwrite").json(f"{out}/header")
    batches.write.mode("overwrite").json(f"{out}/batches")
    trashed.write.mode("overwrite").parquet(f"{out}/trashed")
    deduped.write.mode("overwrite").parquet(f"{out}/deduped")
    summary.write.mode("overwrite").parquet(f"{out}/summary")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(part, field, value) of a header: parameters, totals, snapshot."""
    doc = spark.read.schema(HEADER_SCHEMA).json(path)
    parts = [doc.select(F.lit(c).alias("part"), F.explode(F.col(c).cast("map<string, string>")).alias("field", "value")) for c in doc.columns]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_batch_document(spark: SparkSession, path: str) -> DataFrame:
    """Photo rows of batch documents: one batch per line, as written here."""
    return _photos(spark.read.schema(BATCH_SCHEMA).json(path))


def read_nested_document(spark: SparkSession, path: str) -> DataFrame:
    """Photo rows of whole-file documents that hold their batches in one ``batches`` array."""
    doc = spark.read.schema(f"batches array<struct<{BATCH_SCHEMA.replace(' string', ': string').replace(' bigint', ': bigint').replace('photos array', 'photos: array').replace('::', ':')}>>").option("multiLine", True).json(path)
    return _photos(doc.select(F.explode("batches").alias("b")).select("b.*"))


def _photos(batches: DataFrame) -> DataFrame:
    return batches.select("date", "batch_id", F.posexplode("photos").alias("rank", "p")).select("date", "batch_id", "rank", "p.*")


def ungrouped_document(rest: DataFrame) -> DataFrame:
    """One row about the events in no theme: count, photos, years."""
    per_year = rest.groupBy("year").agg(F.count("*").alias("n"), F.sum("photo_count").alias("p"))
    return per_year.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("event_count"), F.coalesce(F.sum("p"), F.lit(0)).alias("total_photos"), F.array_sort(F.collect_list("year")).alias("years"))


def theme_index(valid: DataFrame, rest: DataFrame, events: DataFrame) -> DataFrame:
    """One row per theme with the overall totals beside it."""
    return valid.select(
        "theme", "theme_folder", "events", "photos", "years", events.agg(F.count("*")).scalar().alias("total_events"),
        rest.agg(F.count("*")).scalar().alias("ungrouped_events"), valid.agg(F.coalesce(F.sum("events"), F.lit(0))).scalar().alias("grouped_events"),
    )
