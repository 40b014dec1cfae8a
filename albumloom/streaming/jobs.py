"""Task, progress and burst feeds as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.functions.rules import error_class
from albumloom.functions.times import epoch_micros
from albumloom.operators.ordering import in_order, running_max, running_sum
from albumloom.params import Curation, Tasks
from albumloom.streaming.runtime import Ledger, event_time


def valid_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("total_chunks")))


def first_chunks(chunks: DataFrame, delay: str) -> DataFrame:
    """Each (task, chunk) once within the watermark; the key spreads a busy task over many partitions."""
    return event_time(valid_chunks(chunks), delay).dropDuplicatesWithinWatermark(["task_id", "chunk_index"])


def _admit(limit: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One task's new chunks in time order; a chunk that would pass the limit is refused."""
        held, kept = int(pdf["held"].iloc[0]), []
        for n in pdf.sort_values(["at", "event_id"]).itertuples(index=False):
            if held + n.bytes <= limit:
                held += n.bytes
                kept.append((n.task_id, n.chunk_index, n.event_id, n.bytes))
        return pd.DataFrame(kept, columns=["task_id", "chunk_index", "event_id", "bytes"])

    return run


ACCEPTED = "task_id bigint, chunk_index int, event_id bigint, bytes bigint"


def chunk_ledger(spark: SparkSession, folder: str, p: Tasks = Tasks()) -> Ledger:
    """Accepted chunks: index in range, each once, bytes of a task within the limit.

    Repeats are reduced to the first per (task, chunk) before anything is grouped by task, so a task brings at
    most its declared number of chunks to the step that adds up bytes.
    """

    def step(batch: DataFrame, state: DataFrame):
        first = valid_chunks(batch).groupBy("task_id", "chunk_index").agg(
            F.min_by(F.struct("event_id", "bytes"), F.struct("ts", "event_id")).alias("c"), F.min(epoch_micros(F.col("ts"))).alias("at")
        )
        new = first.join(state.select("task_id", "chunk_index"), ["task_id", "chunk_index"], "left_anti")
        held = state.groupBy("task_id").agg(F.sum("bytes").alias("held"))
        rows = new.select("task_id", "chunk_index", "at", "c.event_id", "c.bytes").join(held, "task_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        taken = rows.groupBy("task_id").applyInPandas(_admit(p.max_upload_bytes), ACCEPTED)
        return state.unionByName(taken), None

    return Ledger(spark, folder, ACCEPTED, step)


ARRIVED = "task_id bigint, chunk_index int, total_chunks int, at bigint"


def _ready(arrived: DataFrame) -> DataFrame:
    """Tasks of which every chunk is there, with the time the last one first arrived (epoch microseconds)."""
    per = arrived.groupBy("task_id").agg(F.count("*").alias("n"), F.max("total_chunks").alias("total_chunks"), F.max("at").alias("ready_at"))
    return per.where("n = total_chunks").drop("n")


def completed_uploads(spark: SparkSession, folder: str) -> Ledger:
    """One output row per task once every chunk has arrived.

    State is the first arrival per (task, chunk), so repeats of a busy task are summed up before they are moved.
    """

    def step(batch: DataFrame, state: DataFrame):
        new = valid_chunks(batch).select("task_id", "chunk_index", "total_chunks", epoch_micros(F.col("ts")).alias("at"))
        both = new.unionByName(state).groupBy("task_id", "chunk_index").agg(F.max("total_chunks").alias("total_chunks"), F.min("at").alias("at"))
        return both, _ready(both).join(_ready(state).select("task_id"), "task_id", "left_anti")

    return Ledger(spark, folder, ARRIVED, step)


def sessions(events: DataFrame, key: str, gap_seconds: int, delay: str) -> DataFrame:
    """Spells of one key without a gap of ``gap_seconds``: start, deadline (last event plus gap), events.

    Spells are merged within each partition first, so a busy key moves a few rows, not all its events.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    timed = event_time(events, delay)
    rows = timed.groupBy(key, F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("events"))
    return rows.select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("deadline_us"), "events")


def upload_timeouts(events: DataFrame, delay: str, p: Tasks = Tasks()) -> DataFrame:
    """Uploads that ended: idle for too long, or too old whatever happened; finished ones are dropped later."""
    s = sessions(events, "task_id", p.idle_seconds, delay)
    oldest = F.col("start_us") + p.max_age_seconds * 1000000
    aged = F.col("deadline_us") > oldest
    failed = F.when(aged, oldest).otherwise(F.col("deadline_us"))
    return s.select(
        "task_id", "start_us", failed.alias("failed_us"), F.when(aged, "max_age").otherwise("idle").alias("cause"), (failed + p.retention_seconds * 1000000).alias("drop_us")
    )


def stale_heartbeats(events: DataFrame, delay: str, p: Tasks = Tasks()) -> DataFrame:
    """Running tasks whose heartbeat stopped: last beat and the time they count as failed."""
    s = sessions(events, "task_id", p.heartbeat_seconds, delay)
    return s.select("task_id", (F.col("deadline_us") - p.heartbeat_seconds * 1000000).alias("last_beat_us"), F.col("deadline_us").alias("failed_us"), F.col("events").alias("beats"))


# fixed values: states nothing leaves
TERMINAL = ["completed", "failed", "cancelled"]
STATE = "task_id bigint, created_us bigint, updated_us bigint, last_status string, ended_us bigint, end_status string"


def _merged_states(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task_id").agg(
        F.min("created_us").alias("created_us"), F.max("updated_us").alias("updated_us"), F.max_by("last_status", F.struct("updated_us", "last_status")).alias("last_status"),
        F.min("ended_us").alias("ended_us"), F.min_by("end_status", F.when(F.col("ended_us").isNotNull(), F.struct("ended_us", "end_status"))).alias("end_status"),
    )


def task_states(spark: SparkSession, folder: str) -> Ledger:
    """Newest state per task from (task_id, ts, status): the first terminal status stays, else the latest one.

    All parts are minima and maxima, so batches may overlap, repeat or come out of order.
    """

    def step(batch: DataFrame, state: DataFrame):
        end = F.col("status").isin(*TERMINAL)
        at = epoch_micros(F.col("ts"))
        rows = batch.select(
            "task_id", at.alias("created_us"), at.alias("updated_us"), F.col("status").alias("last_status"), F.when(end, at).alias("ended_us"), F.when(end, F.col("status")).alias("end_status")
        )
        return _merged_states(_merged_states(rows).unionByName(state)), None

    return Ledger(spark, folder, STATE, step)


def current_status(states: DataFrame) -> DataFrame:
    return states.select("task_id", "created_us", F.coalesce("ended_us", "updated_us").alias("updated_us"), F.coalesce("end_status", "last_status").alias("status"))


def sliding_throughput(events: DataFrame, delay: str, window: str = "300 seconds", every: str = "60 seconds") -> DataFrame:
    """Items per minute over the last window, refreshed at each step."""
    minutes = float(window.split()[0]) / 60.0
    rows = event_time(events, delay).groupBy(F.window("ts", window, every).alias("w")).agg(F.count("*").alias("items"))
    return rows.select(F.unix_seconds("w.end").alias("window_end"), "items", F.round(F.col("items") / minutes, 6).alias("per_minute"))


FEED = "run bigint, done bigint, first_us bigint, last_us bigint"


def progress_feed(spark: SparkSession, folder: str) -> Ledger:
    """Done counts and time range per run so far."""

    def step(batch: DataFrame, state: DataFrame):
        at = epoch_micros(F.col("ts"))
        rows = batch.groupBy("run").agg(F.count("*").alias("done"), F.min(at).alias("first_us"), F.max(at).alias("last_us"))
        both = rows.unionByName(state).groupBy("run").agg(F.sum("done").alias("done"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
        return both, None

    return Ledger(spark, folder, FEED, step)


def progress_of(feed: DataFrame, totals: DataFrame) -> DataFrame:
    """Percent done and seconds left at the average speed, unknown before time has passed."""
    age = (F.col("last_us") - F.col("first_us")) / 1000000
    left = F.col("total") - F.col("done")
    return feed.join(totals, "run").select(
        "run", "done", "total", F.round(F.col("done") * 100.0 / F.col("total"), 4).alias("percent"), F.round(left * age / F.nullif("done", F.lit(0)), 3).alias("eta_seconds")
    )


POOL = "day string, tag string, first_batch string"


def event_pool(spark: SparkSession, folder: str) -> Ledger:
    """Tags a day's batches can reuse: per batch how many it adds and how many it found.

    Input: (day, batch_id, tag), batches of a day in order of id. State is the first batch of each (day, tag).
    """

    def step(batch: DataFrame, state: DataFrame):
        new = batch.where("tag IS NOT NULL").groupBy("day", "tag").agg(F.min("batch_id").alias("first_batch"))
        pool = new.unionByName(state).groupBy("day", "tag").agg(F.min("first_batch").alias("first_batch"))
        added = pool.groupBy("day", F.col("first_batch").alias("batch_id")).agg(F.count("*").alias("added"))
        seen = batch.select("day", "batch_id").distinct().withColumn("here", F.lit(True))
        rows = added.join(seen, ["day", "batch_id"], "full").withColumn("added", F.coalesce("added", F.lit(0)))
        out = running_sum(in_order(rows, ["day"], ["batch_id"]), ["day"], {"found": F.col("added")}, upto_current=False)
        return pool, out.where("here").select("day", "batch_id", "added", "found")

    return Ledger(spark, folder, POOL, step)


BREAKER = "run bigint, streak bigint, tripped_by bigint, cause string"


def circuit_breaker(spark: SparkSession, folder: str, p: Curation = Curation()) -> Ledger:
    """First call per run that opens the breaker: a fatal error, or the last of so many failures in a row.

    Input: (run, call_id, t, ok, message). State: failures in a row at the end of the last batch.
    """

    def step(batch: DataFrame, state: DataFrame):
        placed = in_order(batch.select("run", "t", "call_id", "ok", "message"), ["run"], ["t", "call_id"])
        placed = running_max(placed, ["run"], {"last_ok": F.when(F.col("ok"), F.col("pos"))})
        carry = state.select("run", F.col("streak").alias("carried"))
        rows = placed.join(carry, "run", "left").withColumn(
            "streak", F.when(F.col("last_ok").isNull(), F.col("pos") + 1 + F.coalesce("carried", F.lit(0))).otherwise(F.col("pos") - F.col("last_ok"))
        )
        fatal = ~F.col("ok") & (error_class(F.col("message")) == "fatal")
        cause = F.when(fatal, "fatal").when(~F.col("ok") & (F.col("streak") >= p.failure_limit), "failures")
        ends = rows.withColumn("cause", cause).groupBy("run").agg(
            F.max_by("streak", "pos").alias("streak"), F.min_by(F.struct("call_id", "cause"), F.when(F.col("cause").isNotNull(), F.col("pos"))).alias("trip")
        )
        new = ends.select("run", F.col("streak").alias("n_streak"), F.col("trip.call_id").alias("n_by"), F.col("trip.cause").alias("n_cause"))
        merged = state.join(new, "run", "full").select(
            "run", F.coalesce("n_streak", "streak").alias("streak"), F.coalesce("tripped_by", "n_by").alias("tripped_by"), F.when(F.col("tripped_by").isNotNull(), F.col("cause")).otherwise(F.col("n_cause")).alias("cause")
        )
        alerts = merged.join(state.where("tripped_by IS NOT NULL").select("run"), "run", "left_anti").where("tripped_by IS NOT NULL")
        return merged, alerts.select("run", "tripped_by", "cause")

    return Ledger(spark, folder, BREAKER, step)


def new_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of files as they appear; a checkpoint remembers those seen. Contents are not read."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return reader.schema(schema).load(folder).select("path", "length")


def dropped_late(query) -> int:
    """Rows (after partial aggregation) a finished query dropped for lying behind the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
