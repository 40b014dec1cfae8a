"""Alias rule documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.functions.replies import held

RULE = "array<struct<name: string, block: boolean, bbox: array<double>>>"


def parse_rules(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) -> rules in list order; a bare list or a list under ``areas``; boxes without four numbers fall out."""
    v = held(documents.select(*keys, "text"), "v", F.try_parse_json("text"))
    listed = F.coalesce(F.try_variant_get("v", "$.areas", RULE), F.try_variant_get("v", "$", RULE))
    rows = v.select(*keys, F.posexplode(listed).alias("ordinal", "r")).where("size(r.bbox) = 4")
    box = [F.get("r.bbox", F.lit(i)).alias(n) for i, n in enumerate(("lat_min", "lng_min", "lat_max", "lng_max"))]
    return rows.select(*keys, "ordinal", "r.name", F.coalesce("r.block", F.lit(False)).alias("block"), *box)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file (read whole: rule files are written by hand)."""
    return parse_rules(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), []).drop("file")
