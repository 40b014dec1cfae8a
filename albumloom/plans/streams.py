"""Streams run over the whole events table until it is used up, next to SQL over the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.plans import views
from albumloom.params import Chunking
from albumloom.plans.oracle import CALLS, CHUNKS, EVENT_DIRS, PHOTOS, with_
from albumloom.plans.photo_core import all_photos, stage_sql
from albumloom.plans.registry import query
from albumloom.session import settle
from albumloom.streaming import jobs, keyed, runtime

# the given events span a month and come as one table, so repeats are remembered for longer than that
MONTHS = "60 days"
DELAY = "10 minutes"
WM = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.stream_table(spark, f"{sf}/events.parquet")


def chunk_stream(spark: SparkSession, sf: str) -> DataFrame:
    return views.chunks(event_stream(spark, sf))


@query("STR-1", sql=with_(CHUNKS, body="SELECT DISTINCT task_id, chunk_index FROM chunks WHERE chunk_index BETWEEN 0 AND total_chunks - 1"))
def chunk_dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.collected(jobs.first_chunks(chunk_stream(spark, sf), MONTHS).select("task_id", "chunk_index"), "chunks")


@query("STR-1", sql=with_(CHUNKS, """firsts AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY epoch_us(ts), event_id) AS n FROM (
   SELECT *, row_number() OVER (PARTITION BY task_id, chunk_index ORDER BY ts, event_id) AS rn FROM chunks WHERE chunk_index BETWEEN 0 AND total_chunks - 1) WHERE rn = 1)""",
   """fold(task_id, n, held, took, chunk_index, event_id) AS (
   SELECT task_id, n, CASE WHEN bytes <= 10737418240 THEN bytes ELSE 0 END, bytes <= 10737418240, chunk_index, event_id FROM firsts WHERE n = 1
   UNION ALL SELECT f.task_id, f.n, CASE WHEN p.held + f.bytes <= 10737418240 THEN p.held + f.bytes ELSE p.held END, p.held + f.bytes <= 10737418240, f.chunk_index, f.event_id FROM fold p JOIN firsts f ON f.task_id = p.task_id AND f.n = p.n + 1)""",
   recursive=True, body="SELECT task_id, chunk_index, event_id FROM fold WHERE took"))
def chunk_ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    ledger = jobs.chunk_ledger(spark, runtime.scratch(spark, "ingest"))
    ledger.run(chunk_stream(spark, sf))
    return ledger.last().select("task_id", "chunk_index", "event_id")


@query("STR-2", sql=with_(CHUNKS, body="""SELECT task_id, 16 AS total_chunks, max(f)::BIGINT AS ready_at FROM (SELECT task_id, chunk_index, min(epoch_us(ts)) AS f FROM chunks WHERE chunk_index BETWEEN 0 AND total_chunks - 1 GROUP BY ALL)
   GROUP BY task_id HAVING count(*) = 16"""))
def upload_complete_stream(spark: SparkSession, sf: str) -> DataFrame:
    ledger = jobs.completed_uploads(spark, runtime.scratch(spark, "complete"))
    ledger.run(chunk_stream(spark, sf))
    return ledger.output("task_id bigint, total_chunks int, ready_at bigint, batch int")


def island_sql(key: str, gap: int, body: str) -> str:
    return f"""WITH marked AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= {gap * 1000000} THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts)),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM marked),
spells AS (SELECT {key} AS task_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + {gap * 1000000} AS deadline_us, count(*) AS events FROM numbered GROUP BY {key}, island HAVING max(ts) + INTERVAL {gap} SECOND <= {WM})
{body}"""


def task_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_stream(spark, sf).select(F.col("user_id").alias("task_id"), "ts")


@query("STR-3", sql=island_sql("user_id", 1800, """SELECT task_id, start_us, failed_us, cause, failed_us + 86400000000 AS drop_us FROM (SELECT *, CASE WHEN deadline_us > start_us + 7200000000 THEN 'max_age' ELSE 'idle' END AS cause, least(deadline_us, start_us + 7200000000) AS failed_us FROM spells)"""))
def upload_timeout_stream(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.collected(jobs.upload_timeouts(task_events(spark, sf), DELAY), "timeouts")


def shuffled_arrivals(df: DataFrame, by: str) -> list[DataFrame]:
    """Three parts by the day a row arrives, up to ten minutes after its ``ts``: out of order, but none behind the watermark."""
    arrived = F.col("ts") + F.make_dt_interval(secs=(F.col(by) * 7919 % 600).cast("decimal(18,6)"))
    part = F.least(F.expr("2"), F.floor((F.dayofmonth(arrived) - 1) / 10))
    return [df.where(part == k) for k in range(3)]


WM_SECOND = "(SELECT (epoch_ms(max(ts)) - 600000) // 1000 FROM events)"


@query("STR-3", sql=f"""WITH RECURSIVE seconds AS (SELECT user_id % 4 AS task_id, epoch_us(ts) // 1000000 AS t, count(*) AS n, bool_or(event_id % 40 = 0) AS done FROM events GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY t) AS k FROM seconds WHERE t + 1 <= {WM_SECOND}),
fold AS (SELECT task_id, k, t AS start, t AS last, done, n AS chunks, 0::HUGEINT AS refused FROM numbered WHERE k = 1
  UNION ALL SELECT task_id, k, CASE WHEN fresh THEN t ELSE start END, CASE WHEN fresh OR live THEN t ELSE last END, CASE WHEN fresh OR live THEN now_done ELSE done END,
    CASE WHEN fresh THEN n WHEN live THEN chunks + n ELSE chunks END, CASE WHEN fresh THEN 0 WHEN live THEN refused ELSE refused + n END
  FROM (SELECT *, NOT done AND t <= ended AS live, t > ended + 86400 AS fresh FROM (
    SELECT f.task_id, f.k, f.t, f.n, f.done AS now_done, p.start, p.last, p.done, p.chunks, p.refused, CASE WHEN p.done THEN p.last ELSE least(p.last + 1800, p.start + 7200) END AS ended
    FROM fold p JOIN numbered f ON f.task_id = p.task_id AND f.k = p.k + 1))),
lives AS (SELECT *, CASE WHEN done THEN last ELSE least(last + 1800, start + 7200) END AS ended FROM (
  SELECT task_id, start, arg_max(last, k) AS last, arg_max(done, k) AS done, arg_max(chunks, k) AS chunks, arg_max(refused, k) AS refused FROM fold GROUP BY ALL))
SELECT task_id, start, ended AS at, CASE WHEN done THEN 'finished' WHEN start + 7200 <= last + 1800 THEN 'max_age' ELSE 'idle' END AS event, chunks::BIGINT AS chunks FROM lives WHERE done OR {WM_SECOND} > ended
UNION ALL SELECT task_id, start, ended + 86400, 'dropped', refused::BIGINT FROM lives WHERE {WM_SECOND} > ended + 86400""")
def upload_life_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Four busy uploaders, in three arrivals out of order."""
    chunks = views.table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("task_id"), "ts", (F.col("event_id") % 40 == 0).alias("done"))
    with keyed.keyed_state(spark):
        return runtime.over_arrivals(shuffled_arrivals(chunks, "event_id"), lambda s: keyed.upload_life(s, DELAY), "uploads")


@query("STR-4", sql=island_sql("user_id", 60, "SELECT task_id, deadline_us - 60000000 AS last_beat_us, deadline_us AS failed_us, events AS beats FROM spells"))
def stale_heartbeat_stream(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.collected(jobs.stale_heartbeats(task_events(spark, sf), DELAY), "beats")


STATUS = "['uploading', 'queued', 'running', 'completed', 'failed'][list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type)]"


@query("STR-5", sql=f"""SELECT task_id, created_us, coalesce(ended_us, updated_us) AS updated_us, coalesce(end_status, last_status) AS status FROM (
  SELECT user_id * 100000 + event_id // 200 AS task_id, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us, arg_max(status, (ts, status)) AS last_status, epoch_us(min(ts) FILTER (status IN ('completed', 'failed'))) AS ended_us,
     arg_min(status, (ts, status)) FILTER (status IN ('completed', 'failed')) AS end_status FROM (SELECT *, {STATUS} AS status FROM events) GROUP BY 1)""")
def task_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("view", "uploading", "click", "queued", "signup", "running", "purchase", "completed", "error", "failed")])
    s = event_stream(spark, sf).select((F.col("user_id") * 100000 + F.expr("event_id div 200")).alias("task_id"), "ts", names[F.col("event_type")].alias("status"))
    ledger = jobs.task_states(spark, runtime.scratch(spark, "states"))
    ledger.run(s)
    return jobs.current_status(ledger.last())


@query("STR-6", sql=f"""SELECT window_end, count(*) AS items, round(count(*) / 5.0::DOUBLE, 6) AS per_minute FROM (
   SELECT (epoch_us(ts) // 60000000 + 1 + o) * 60 AS window_end FROM events, (VALUES (0), (1), (2), (3), (4)) v(o)) GROUP BY window_end HAVING make_timestamp(window_end * 1000000) <= {WM}""")
def throughput_stream(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.collected(jobs.sliding_throughput(event_stream(spark, sf).select("ts"), DELAY), "throughput")


@query("STR-7", sql="""SELECT run, done, total, round(done * 100.0::DOUBLE / total, 4) AS percent, round((total - done) * ((last_us - first_us) / 1000000::DOUBLE) / nullif(done, 0), 3) AS eta_seconds FROM (
   SELECT user_id AS run, count(*) FILTER (event_type <> 'error') AS done, count(*) AS total, epoch_us(min(ts) FILTER (event_type <> 'error')) AS first_us, epoch_us(max(ts) FILTER (event_type <> 'error')) AS last_us FROM events GROUP BY 1) WHERE done > 0""")
def progress_stream(spark: SparkSession, sf: str) -> DataFrame:
    ledger = jobs.progress_feed(spark, runtime.scratch(spark, "progress"))
    ledger.run(event_stream(spark, sf).where("event_type != 'error'").select(F.col("user_id").alias("run"), "ts"))
    totals = views.table(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("total"))
    return jobs.progress_of(ledger.last(), totals)


@query("STR-8", sql=island_sql("user_id", 1800, "SELECT task_id AS owner, start_us, deadline_us, events FROM spells"))
def burst_stream(spark: SparkSession, sf: str) -> DataFrame:
    s = event_stream(spark, sf).select(F.col("user_id").alias("owner"), "ts")
    return runtime.collected(jobs.sessions(s, "owner", 1800, DELAY), "bursts")


@query("STR-8", sql=with_(PHOTOS, all_photos(), *stage_sql(Chunking())[:2], body=f"SELECT day::VARCHAR AS day, t, count(*) AS n, segment FROM segmented WHERE t + 1 <= {WM_SECOND} GROUP BY ALL"))
def segment_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The time and hash rule over photos that arrive out of order, in three arrivals."""
    photos = views.photos(spark, sf).select(F.col("day").cast("string").alias("day"), "photo_id", "hash_hi", "hash_lo")
    timed = photos.join(views.table(spark, sf, "events").select(F.col("event_id").alias("photo_id"), "ts"), "photo_id")
    with keyed.keyed_state(spark):
        return runtime.over_arrivals(shuffled_arrivals(timed, "photo_id"), lambda s: keyed.segment_stream(s, DELAY), "segments")


@query("STR-9")
def new_file_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = runtime.collected(jobs.new_files(spark, sf, "*.parquet"), "files")
    return out.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


@query("STR-9", sql="SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, least((day(ts) - 1) // 10, 2)::INT AS arrival FROM events")
def new_file_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """A file per day, in three arrivals: each is found by the run after it came, and by no other run of the checkpoint."""
    folder = runtime.scratch(spark, "arrivals")
    days = views.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10)).alias("part"))
    found = []
    for k in range(3):
        days.where(F.col("part") == k).select("event_id", "day").repartition("day").write.mode("append").partitionBy("day").parquet(f"{folder}/in")
        runtime.finish(jobs.new_files(spark, f"{folder}/in", "*.parquet"), f"{folder}/found", f"{folder}/checkpoint")
        found.append(settle(spark.read.schema("path string, length bigint").parquet(f"{folder}/found").select("path", F.lit(k).alias("arrival"))))
    # a file that is found twice stands twice in the last list
    first = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("path").agg(F.min("arrival").alias("arrival"))
    return found[2].select("path").join(first, "path").select(F.regexp_extract("path", "day=([^/]+)", 1).alias("day"), "arrival")


@query("STR-10", sql=with_(EVENT_DIRS, body="""SELECT day, grp AS batch_id, count(*) FILTER (first_grp = grp) AS added, (SELECT count(DISTINCT b.folder) FROM event_dirs b WHERE b.day = a.day AND b.grp < a.grp) AS found
   FROM (SELECT *, min(grp) OVER (PARTITION BY day, folder) AS first_grp FROM event_dirs) a GROUP BY day, grp"""))
def event_pool_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = runtime.scratch(spark, "pool")
    views.event_dirs(spark, sf).select("day", F.col("grp").alias("batch_id"), F.col("folder").alias("tag")).write.parquet(f"{folder}/in")
    ledger = jobs.event_pool(spark, folder)
    ledger.run(runtime.stream_table(spark, f"{folder}/in"))
    return ledger.output("day string, batch_id string, added bigint, found bigint, batch int")


@query("STR-11", sql=with_(CALLS, body="""SELECT run, tripped_by, cause FROM (SELECT run, call_id AS tripped_by, CASE WHEN fatal THEN 'fatal' ELSE 'failures' END AS cause, row_number() OVER (PARTITION BY run ORDER BY t, call_id) AS rn FROM (
   SELECT *, coalesce(message LIKE 'Insuff%' OR message LIKE '%unauthorized%', false) AS fatal, row_number() OVER (PARTITION BY run, island ORDER BY t, call_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS streak
   FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY run ORDER BY t, call_id) AS island FROM calls)) WHERE NOT ok AND (fatal OR streak >= 5)) WHERE rn = 1"""))
def circuit_breaker_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = runtime.scratch(spark, "breaker")
    ledger = jobs.circuit_breaker(spark, folder)
    ledger.run(views.calls_of(event_stream(spark, sf)))
    return ledger.output("run bigint, tripped_by bigint, cause string, batch int")


@query("STR-12", sql="""WITH w0 AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS wm FROM events WHERE event_id % 3 = 0), w1 AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS wm FROM events)
SELECT e AS window_end, count(*) AS items FROM (SELECT *, (epoch_us(ts) // 600000000 + 1) * 600 AS e FROM events), w0, w1
WHERE (event_id % 3 < 2 OR make_timestamp(e * 1000000) > w0.wm) AND make_timestamp(e * 1000000) <= w1.wm GROUP BY e""")
def late_data_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = runtime.scratch(spark, "late")
    e = views.table(spark, sf, "events").select("event_id", "ts")
    # three arrivals over the same month; a batch drops what lies behind the watermark of the batch before the last
    for third in range(3):
        e.where(F.col("event_id") % 3 == third).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s = runtime.event_time(runtime.stream_table(spark, f"{folder}/in", files_per_trigger=1), DELAY)
    counts = s.groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("items"))
    return runtime.collected(counts.select(F.unix_seconds("w.end").alias("window_end"), "items"), "late")
