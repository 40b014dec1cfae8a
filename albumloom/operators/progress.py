"""Speed, remaining time, failure runs and queue places of running jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumloom.operators.ordering import in_order, running_max
from albumloom.params import Curation


#: seconds of a run that one window may see
STRETCH = 8192


def throughput(done: DataFrame, totals: DataFrame, p: Curation = Curation()) -> DataFrame:
    """(run, t) completions and (run, total) -> speed over the last window, average speed and ETA at each second.

    Completions are summed up per second first. A run is cut into stretches of seconds; the last ones of a stretch are
    also carried into the next, so that the speed at a second is seen whole there, and one row per stretch brings what
    was done before it. So a run of any length is spread over many tasks. The window is shorter than a stretch.
    """
    size = max(STRETCH, 2 * p.window_seconds)
    per = done.groupBy("run", "t").agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("t") / size))
    late = F.col("t") - F.col("stretch") * size >= size - p.window_seconds
    seen = F.when(late, F.array("stretch", F.col("stretch") + 1)).otherwise(F.array("stretch"))
    rows = per.select("run", "t", "n", F.col("stretch").alias("home"), F.explode(seen).alias("stretch")).withColumn("own", F.col("home") == F.col("stretch"))
    inside = Window.partitionBy("run", "stretch").orderBy("t")
    # sums from the start on grow row by row; a frame that slides would be added up anew for each row
    out_of_sight = F.sum("n").over(inside.rangeBetween(Window.unboundedPreceding, -p.window_seconds - 1))
    rows = rows.select(
        "run", "t", "stretch", "own", F.sum(F.when(F.col("own"), F.col("n"))).over(inside).alias("so_far"), (F.sum("n").over(inside) - F.coalesce(out_of_sight, F.lit(0))).alias("recent")
    ).where("own")
    # one row per stretch of a run
    stretches = per.groupBy("run", "stretch").agg(F.sum("n").alias("n"), F.min("t").alias("first"))
    before = Window.partitionBy("run").orderBy("stretch")
    stretches = stretches.select(
        "run", "stretch", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.min("first").over(before).alias("start")
    )
    rows = rows.join(stretches, ["run", "stretch"]).withColumn("done", F.col("earlier") + F.col("so_far")).join(totals, "run")
    age = F.greatest((F.col("t") - F.col("start")).cast("double"), F.lit(1e-6))
    window = F.least(age, F.lit(float(p.window_seconds)))
    rate = F.col("done") / age
    left = F.greatest(F.col("total") - F.col("done"), F.lit(0))
    return rows.where("t > start").select(
        "run", "t", "done", "recent", F.round(F.col("recent") / window * 60.0, 6).alias("recent_per_minute"), F.round(rate * 60.0, 6).alias("average_per_minute"),
        F.round(left / rate, 4).alias("eta_seconds"), F.round(F.col("done") * 100.0 / F.col("total"), 4).alias("percent"),
    )


def failure_runs(calls: DataFrame, p: Curation = Curation()) -> DataFrame:
    """Failed calls with their number in the unbroken row of failures; ``tripped`` from the limit on."""
    placed = in_order(calls.select("run", "t", "call_id", "ok"), ["run"], ["t", "call_id"])
    placed = running_max(placed, ["run"], {"last_ok": F.when(F.col("ok"), F.col("pos"))})
    streak = F.col("pos") - F.coalesce("last_ok", F.lit(-1))
    return placed.where("NOT ok").select("run", "call_id", streak.alias("streak"), (streak >= p.failure_limit).alias("tripped"))


def queue_places(queued: DataFrame) -> DataFrame:
    """1-based place of each queued task by entry time."""
    return in_order(queued, [], ["entered", "task_id"]).select("task_id", (F.col("pos") + 1).alias("place"))


def chunked(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Rows in fixed-size chunks by order: ``chunk`` from 0, ``number`` from 1 inside the chunk."""
    placed = in_order(rows, keys, order)
    return placed.withColumn("chunk", F.floor(F.col("pos") / size)).withColumn("number", F.col("pos") % size + 1).drop("pos")
