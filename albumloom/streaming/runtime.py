"""Running streams to the end of their input, and keyed state kept as versioned tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from albumloom.functions.times import epoch_micros
from albumloom.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table, file or folder, as a stream with the schema it has."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern, so that one file serves as well as a folder of them
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def event_time(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Zone-less times, read as UTC, as event time with a watermark."""
    return stream.withColumn(ts, F.timestamp_micros(epoch_micros(F.col(ts)))).withWatermark(ts, delay)


def finish(stream: DataFrame, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append everything available now to a parquet folder and wait."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or scratch(spark, "stream"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def collected(stream: DataFrame, name: str) -> DataFrame:
    """What an append stream has put out once its input is used up."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    finish(stream, out)
    return spark.read.schema(stream.schema).parquet(out)


def over_arrivals(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What an append stream puts out when its input comes in parts: one run of one checkpoint after each part."""
    spark = parts[0].sparkSession
    folder = scratch(spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = transform(stream_table(spark, f"{folder}/in"))
        finish(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class Ledger:
    """State of a ``foreachBatch`` job: one parquet version per micro-batch.

    ``step(batch, state) -> (state, output)``. A batch that runs again reads the version before it and writes
    its own once more, so a lost executor or a restart changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]):
        self.spark, self.folder, self.schema, self.step = spark, folder, schema, step

    def version(self, n: int) -> DataFrame:
        if n < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/state/v={n}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        state, output = self.step(batch, self.version(batch_id - 1))
        state.write.mode("overwrite").parquet(f"{self.folder}/state/v={batch_id}")
        if output is not None:
            output.write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch_id}")

    def run(self, stream: DataFrame) -> StreamingQuery:
        query = (
            stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return query

    def last(self) -> DataFrame:
        """Newest state."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        versions = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)]
        return self.version(max(versions))

    def output(self, schema: str) -> DataFrame:
        """All output rows."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/out").drop("batch")
