"""Upload and analysis tasks on finished tables; the streaming twins live in ``albumloom.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: states that hold a place in the service
IN_FLIGHT = ["uploading", "ready", "queued", "running"]


def task_totals(tasks: DataFrame) -> DataFrame:
    """Tasks per status and how many are in flight."""
    per = tasks.groupBy("status").agg(F.count("*").alias("n"))
    return per.withColumn("in_flight", F.col("status").isin(*IN_FLIGHT))


def orphans(tasks: DataFrame, live: DataFrame) -> DataFrame:
    """In-flight tasks no live worker knows, marked failed."""
    lost = tasks.where(F.col("status").isin(*IN_FLIGHT)).join(live.select("task_id"), "task_id", "left_anti")
    return lost.select("task_id", F.col("status").alias("was"), F.lit("failed").alias("status"))
