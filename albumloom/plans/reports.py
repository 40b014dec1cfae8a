"""Model comparison, run logs, removal lists against the gallery, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.operators import compare, logs, matching, tasks
from albumloom.params import Matching
from albumloom.plans import views
from albumloom.plans.oracle import DECISIONS, DELETE_ENTRIES, GALLERY, LIST_LINES, RUN_LOGS, STAGE_LOGS, with_
from albumloom.plans.registry import query
from albumloom.sources import library, lists

MODELS = ["A", "B", "C", "D"]
# dates in the given tables lie days apart, so the tolerances are wider than a phone's
DAYS60 = Matching(time_tolerance_ms=60 * 86400 * 1000, size_tolerance=5_000_000)


@query("SRC-9", sql=with_(DECISIONS, body="SELECT 'run_' || model || '.log' AS file, photo_id, decision, CASE WHEN decision = 'keep' THEN day || '-x' ELSE '' END AS event_tag, reason FROM decisions"))
def log_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return compare.log_decisions(views.run_logs(spark, sf))


META = """SELECT file, '/lib/' || CASE WHEN model = 'D' THEN 'b' ELSE 'a' END AS input_dir, CASE WHEN model = 'C' THEN 'openai' ELSE 'ollama' END AS provider,
   'org/vision-' || CASE WHEN model = 'B' THEN 'A' ELSE model END || '-with-a-very-long-name' AS model, CASE WHEN model = 'C' THEN 'C' ELSE 'A' END AS extraction_level, n * 1234 AS token_total, gone AS deleted, gone - 1 AS deleted_after_dedup,
   kept_lines AS kept, all_lines AS total_photos FROM meta"""


@query("SRC-10", sql=with_(RUN_LOGS, body=META))
def log_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return compare.log_metadata(views.run_logs(spark, sf))


@query("SCL-25", sql=with_(RUN_LOGS, body="""SELECT file, CASE model WHEN 'A' THEN 'ollama-vision-A-with-a-very' WHEN 'B' THEN 'ollama-vision-A-with-a-very#2' WHEN 'C' THEN 'openai-vision-C-with-a-very' ELSE 'ollama-vision-D-with-a-very' END AS run_key FROM meta"""))
def run_keys(spark: SparkSession, sf: str) -> DataFrame:
    return compare.run_keys(log_metadata(spark, sf)).select("file", "run_key")


@query("AGG-19", sql=with_(RUN_LOGS, body="""SELECT attribute, variants FROM (SELECT 'input_dir' AS attribute, 2::BIGINT AS variants UNION ALL SELECT 'total_photos', (SELECT count(DISTINCT all_lines) FROM meta) UNION ALL SELECT 'extraction_level', 2) WHERE variants > 1"""))
def same_input_check(spark: SparkSession, sf: str) -> DataFrame:
    return compare.same_input_errors(log_metadata(spark, sf))


WIDE = """wide AS (SELECT photo_id, coalesce(max(decision) FILTER (model = 'A'), 'MISSING') AS A, coalesce(max(decision) FILTER (model = 'B'), 'MISSING') AS B, coalesce(max(decision) FILTER (model = 'C'), 'MISSING') AS C,
   coalesce(max(decision) FILTER (model = 'D'), 'MISSING') AS D, CASE WHEN count(DISTINCT decision) = 1 THEN '一致' ELSE '不一致' END AS consensus, count(*) FILTER (decision = 'keep') AS k, count(*) FILTER (decision = 'delete') AS d_n,
   max(model) FILTER (decision = 'keep') AS keeper, max(model) FILTER (decision = 'delete') AS deleter FROM decisions GROUP BY photo_id)"""


@query("JOIN-13", "SET-4", sql=with_(DECISIONS, WIDE, body="SELECT photo_id, A, B, C, D, consensus FROM wide"))
def comparison_table(spark: SparkSession, sf: str) -> DataFrame:
    return compare.comparison_table(views.decisions(spark, sf), MODELS)


@query("SET-4", sql=with_(DECISIONS, body="SELECT DISTINCT photo_id FROM decisions"))
def judged_photos(spark: SparkSession, sf: str) -> DataFrame:
    d = views.decisions(spark, sf)
    return d.where("model = 'A'").select("photo_id").union(d.where("model != 'A'").select("photo_id")).distinct()


@query("AGG-17", sql=with_(DECISIONS, WIDE, body="SELECT consensus, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM wide), 1) AS pct FROM wide GROUP BY consensus"))
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    return compare.consensus_counts(comparison_table(spark, sf))


PATTERN = "CASE WHEN k = 1 THEN 'only_' || keeper || '_kept' WHEN d_n = 1 THEN 'only_' || deleter || '_deleted' ELSE 'complex_disagreement' END"


@query("AGG-18", sql=with_(DECISIONS, WIDE, body=f"SELECT photo_id, {PATTERN} AS pattern FROM wide WHERE consensus = '不一致'"))
def disagreement_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return compare.disagreements(comparison_table(spark, sf), MODELS)


@query("AGG-20", sql=with_(DECISIONS, body="SELECT model, count(*) AS total, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision <> 'keep') AS deleted, round(count(*) FILTER (decision = 'keep') * 100.0::DOUBLE / count(*), 1) AS keep_pct FROM decisions GROUP BY model"))
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    return compare.run_stats(views.decisions(spark, sf))


def words_sql(source: str, pattern: str) -> str:
    return f"""SELECT model, decision, word, n, all_words, rank FROM (SELECT *, row_number() OVER (PARTITION BY model, decision ORDER BY n DESC, word) AS rank, (sum(n) OVER (PARTITION BY model, decision))::BIGINT AS all_words
  FROM (SELECT model, decision, word, count(*) AS n FROM (SELECT model, decision, unnest(regexp_extract_all(body, '{pattern}')) AS word FROM {source}) GROUP BY ALL)) WHERE rank <= 10"""


@query("AGG-21", sql=with_(DECISIONS, body=words_sql("(SELECT *, reason AS body FROM decisions)", r"[\x{4e00}-\x{9fff}]{2,}")).replace("rank FROM", "rank::INT AS rank FROM", 1))
def reason_keywords(spark: SparkSession, sf: str) -> DataFrame:
    d = views.decisions(spark, sf)
    return compare.keywords(compare.word_counts(d, compare.chinese_tokens(F.col("reason"))))


@query("AGG-21", sql=with_(DECISIONS, body=words_sql("(SELECT d.model, d.decision, lower(text) AS body FROM decisions d JOIN documents USING (doc_id))", "[a-z]{2,}")).replace("rank FROM", "rank::INT AS rank FROM", 1))
def text_keywords(spark: SparkSession, sf: str) -> DataFrame:
    text = views.table(spark, sf, "documents").select("doc_id", "text").select("doc_id", F.lower("text").alias("body"))
    return compare.keywords(compare.document_word_counts(views.decisions(spark, sf), text, F.regexp_extract_all("body", F.lit("[a-z]{2,}"), F.lit(0)), "doc_id"))


@query("AGG-21", sql=with_(DECISIONS, body="""SELECT model, decision, sum(n)::BIGINT AS all_words, least(count(*), 10) AS told, true AS within, false AS missed
  FROM (SELECT model, decision, word, count(*) AS n FROM (SELECT d.model, d.decision, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM decisions d JOIN documents USING (doc_id)) GROUP BY ALL) GROUP BY ALL"""))
def text_keywords_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """The sketch held against the exact counts, by its error bound."""
    d, body = views.decisions(spark, sf), views.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("body"))
    tokens = F.regexp_extract_all("body", F.lit("[a-z]{2,}"), F.lit(0))
    return compare.sketch_against_exact(compare.sketched_words(d, body, tokens, "doc_id"), compare.document_word_counts(d, body, tokens, "doc_id"))


@query("OPS-14", "SNK-7", sql=with_(DECISIONS, WIDE, body=f"""SELECT '差异' AS sheet, {PATTERN} AS item, count(*) AS n FROM wide WHERE consensus = '不一致' GROUP BY 2 UNION ALL SELECT '一致性', consensus, count(*) FROM wide GROUP BY consensus
  UNION ALL SELECT '保留', CASE model WHEN 'A' THEN 'ollama-vision-A-with-a-very' WHEN 'B' THEN 'ollama-vision-A-with-a-very#2' WHEN 'C' THEN 'openai-vision-C-with-a-very' ELSE 'ollama-vision-D-with-a-very' END, count(*) FILTER (decision = 'keep') FROM decisions GROUP BY model""").replace("SELECT '差异' AS sheet, CASE WHEN k = 1 THEN 'only_' || keeper", "SELECT '差异' AS sheet, CASE WHEN k = 1 THEN 'only_' || keeper"))
def log_comparison(spark: SparkSession, sf: str) -> DataFrame:
    lines = views.run_logs(spark, sf)
    got = compare.log_decisions(lines).withColumn("model", F.regexp_extract("file", "run_(.)", 1))
    wide = compare.comparison_table(got, MODELS)
    keys = compare.run_keys(compare.log_metadata(lines)).select("file", "run_key")
    kept = got.groupBy("file").agg(F.count_if(F.col("decision") == "keep").alias("n")).join(keys, "file")
    sheet = compare.disagreements(wide, MODELS).groupBy(F.col("pattern").alias("item")).agg(F.count("*").alias("n")).select(F.lit("差异").alias("sheet"), "item", "n")
    return sheet.unionByName(compare.consensus_counts(wide).select(F.lit("一致性").alias("sheet"), F.col("consensus").alias("item"), "n")).unionByName(
        kept.select(F.lit("保留").alias("sheet"), F.col("run_key").alias("item"), "n")
    )


@query("AGG-16", sql=with_(DECISIONS, body="""SELECT *, round(archived / nullif(in_pipeline, 0)::DOUBLE, 6) AS rate_in_pipeline, round(archived / nullif(scanned, 0)::DOUBLE, 6) AS rate_scanned,
   CASE level WHEN 'A' THEN archived / in_pipeline::DOUBLE BETWEEN 0.2 AND 0.45 WHEN 'B' THEN archived / in_pipeline::DOUBLE BETWEEN 0.5 AND 0.8 ELSE archived / in_pipeline::DOUBLE BETWEEN 0.99 AND 1 END AS within_band
  FROM (SELECT CASE model WHEN 'D' THEN 'A' WHEN 'A' THEN 'B' ELSE model END AS level, model, count(*) FILTER (decision = 'keep') AS archived, count(*) AS in_pipeline, (SELECT count(*) FROM documents) AS scanned FROM decisions GROUP BY model)"""))
def extraction_rates(spark: SparkSession, sf: str) -> DataFrame:
    d = views.decisions(spark, sf)
    level = F.when(F.col("model") == "D", "A").when(F.col("model") == "A", "B").otherwise(F.col("model"))
    per = d.groupBy(level.alias("level"), "model").agg(F.count_if(F.col("decision") == "keep").alias("archived"), F.count("*").alias("in_pipeline"))
    scanned = views.table(spark, sf, "documents").agg(F.count("*")).scalar()
    return compare.extraction_rates(per.withColumn("scanned", scanned))


PROGRESS = """SELECT run, at_ AS "at", CASE WHEN k < 6 THEN 'stage' WHEN k < 30 THEN 'hashing' WHEN k < 40 THEN 'step' WHEN k < 70 THEN ['batches', 'days', 'themes', 'clusters'][k % 4 + 1]
    WHEN k < 80 THEN CASE WHEN k % 2 = 0 THEN 'batches' WHEN k % 3 = 0 THEN 'themes' ELSE 'days' END ELSE 'lookup' END AS kind,
  CASE WHEN k < 6 THEN ['01a', '01b', '02', '03a', '03b'][k % 5 + 1] END AS stage, CASE WHEN k >= 20 AND NOT k BETWEEN 30 AND 39 THEN done::BIGINT END AS done, CASE WHEN k >= 20 AND NOT k BETWEEN 30 AND 39 THEN total::BIGINT END AS total,
  round(CASE WHEN k < 6 THEN 0.0::DOUBLE WHEN k < 30 THEN 0.15::DOUBLE + 0.75::DOUBLE * done / total WHEN k < 40 THEN [0.05::DOUBLE, 0.15, 0.9][k % 3 + 1]
    WHEN k < 70 THEN CASE k % 4 WHEN 2 THEN 0.5::DOUBLE + 0.5::DOUBLE * pct WHEN 3 THEN 0.5::DOUBLE * pct ELSE pct END WHEN k < 80 THEN CASE WHEN k % 2 = 1 AND k % 3 = 0 THEN 0.5::DOUBLE + 0.5::DOUBLE * done / total ELSE done / total::DOUBLE END ELSE done / total::DOUBLE END, 6) AS bar,
  CASE WHEN k BETWEEN 40 AND 69 THEN '5m03s' WHEN k >= 80 THEN '3.4min' END AS eta, CASE WHEN k BETWEEN 40 AND 69 THEN '06-12 18:30:00' END AS finish
 FROM (SELECT *, round(done * 100.0::DOUBLE / total, 1) / 100 AS pct FROM stage_logs) WHERE k < 6 OR k BETWEEN 20 AND 89"""


@query("SCL-26", sql=with_(STAGE_LOGS, body=PROGRESS))
def progress_lines(spark: SparkSession, sf: str) -> DataFrame:
    return logs.progress_lines(views.stage_logs(spark, sf))


STAGED = """heads AS (SELECT run, at_, CASE WHEN k < 6 THEN ['01a', '01b', '02', '03a', '03b'][k % 5 + 1] END AS stage, k FROM stage_logs)"""


@query("AGG-24", sql=with_(STAGE_LOGS, STAGED, body="""SELECT run, coalesce(cur, '?') AS stage, count(*) AS warnings FROM (SELECT *, last_value(stage IGNORE NULLS) OVER (PARTITION BY run ORDER BY at_) AS cur FROM heads) WHERE k BETWEEN 6 AND 19 GROUP BY 1, 2"""))
def warnings_per_stage(spark: SparkSession, sf: str) -> DataFrame:
    return logs.warnings_per_stage(views.stage_logs(spark, sf))


@query("WIN-13", sql=with_(STAGE_LOGS, STAGED, body="""SELECT run, s.stage, CASE WHEN s.i = now THEN 'running' WHEN s.stage = '03a' THEN 'skipped' WHEN s.i < now THEN 'done' ELSE 'pending' END AS state
  FROM (SELECT run, list_position(['01a', '01b', '02', '03a', '03b'], arg_max(stage, at_)) AS now FROM heads WHERE stage IS NOT NULL GROUP BY run), (VALUES ('01a', 1), ('01b', 2), ('02', 3), ('03a', 4), ('03b', 5)) s(stage, i)"""))
def stage_states(spark: SparkSession, sf: str) -> DataFrame:
    return logs.stage_states(views.stage_logs(spark, sf), ["03a"])


@query("SRC-11", "SORT-1", sql=with_(GALLERY, body="SELECT item_id, name, taken_ms FROM gallery WHERE taken_ms BETWEEN 820454400000 AND 851990399999"))
def gallery_range(spark: SparkSession, sf: str) -> DataFrame:
    return library.date_range(views.gallery(spark, sf), 820454400000, 851990399999).select("item_id", "name", "taken_ms")


@query("SRC-8", sql=with_(LIST_LINES, body="SELECT file, mode FROM modes"))
def list_modes(spark: SparkSession, sf: str) -> DataFrame:
    return lists.list_modes(views.list_lines(spark, sf))


@query("SRC-7", sql=with_(LIST_LINES, body="""SELECT file, pos AS "at", mode, name, CASE WHEN mode = 'SIZE' THEN v ELSE -1 END AS size, CASE WHEN mode = 'DATETIME' AND v > 0 THEN v * 1000 ELSE -1 END AS taken_ms FROM (
   SELECT file, pos, trim(split_part(line, '|', 1)) AS name, coalesce(try_cast(trim(split_part(line, '|', 2)) AS BIGINT), -1) AS v FROM list_lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND len(string_split(line, '|')) = 2) JOIN modes USING (file) WHERE name <> ''"""))
def list_entries(spark: SparkSession, sf: str) -> DataFrame:
    return lists.parsed_list(views.list_lines(spark, sf))


@query("AGG-22", sql=with_(LIST_LINES, body="SELECT d AS delete_count, greatest(0, n - d)::BIGINT AS keep_count FROM (SELECT count(*) FILTER (trim(line) <> '' AND NOT starts_with(line, '#')) AS d FROM list_lines), (SELECT count(*) AS n FROM lineitem)"))
def result_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matching.result_counts(views.list_lines(spark, sf), views.table(spark, sf, "lineitem"))


@query("JOIN-10", sql=with_(GALLERY, DELETE_ENTRIES, body="""SELECT item_id, name, taken_ms, g.size, want_ms > 0 AND abs(taken_ms - want_ms) > 2000 AS warning FROM gallery g JOIN entries USING (name) WHERE want_ms <= 0 OR abs(taken_ms - want_ms) < 5184000000"""))
def match_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_by_time(views.gallery(spark, sf), views.delete_entries(spark, sf), DAYS60)


@query("JOIN-11", sql=with_(GALLERY, DELETE_ENTRIES, body="""SELECT item_id, name, taken_ms, g.size, false AS warning FROM gallery g JOIN entries USING (name) WHERE want_size = -1 OR abs(g.size - want_size) < 5000000"""))
def match_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_by_size(views.gallery(spark, sf), views.delete_entries(spark, sf), DAYS60)


@query("JOIN-12", sql=with_(GALLERY, DELETE_ENTRIES, body="""SELECT item_id, name FROM gallery g JOIN entries USING (name) WHERE (want_ms <= 0 OR abs(taken_ms - want_ms) < 5184000000) AND item_id IN (SELECT item_id FROM gallery WHERE part % 10 < 8)"""))
def still_present(spark: SparkSession, sf: str) -> DataFrame:
    g = views.gallery(spark, sf)
    return matching.still_present(matching.match_by_time(g, views.delete_entries(spark, sf), DAYS60), g.where("part % 10 < 8")).select("item_id", "name")


STATUS = "CASE o_orderstatus WHEN 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'uploading' WHEN 1 THEN 'ready' WHEN 2 THEN 'queued' ELSE 'running' END WHEN 'P' THEN 'cancelled' ELSE 'completed' END"


def task_table(spark: SparkSession, sf: str) -> DataFrame:
    i, s = F.col("o_orderkey"), F.col("o_orderstatus")
    flying = F.element_at(F.array(F.lit("uploading"), F.lit("ready"), F.lit("queued"), F.lit("running")), (i % 4 + 1).cast("int"))
    return views.table(spark, sf, "orders").select(i.alias("task_id"), F.when(s == "O", flying).when(s == "P", "cancelled").otherwise("completed").alias("status"), "o_custkey")


@query("AGG-25", sql=f"SELECT {STATUS} AS status, count(*) AS n, {STATUS} IN ('uploading', 'ready', 'queued', 'running') AS in_flight FROM orders GROUP BY 1")
def task_totals(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.task_totals(task_table(spark, sf))


@query("SET-5", sql=f"SELECT o_orderkey AS task_id, {STATUS} AS was, 'failed' AS status FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 <> 0")
def orphan_tasks(spark: SparkSession, sf: str) -> DataFrame:
    t = task_table(spark, sf)
    return tasks.orphans(t, t.where("o_custkey % 3 = 0"))


def alias_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rule documents, one per supplier: a bare list or wrapped in ``areas``; some boxes are malformed."""
    i = F.col("s_suppkey")
    box = F.format_string("[%.3f, %.3f, %.3f, %.3f]", F.col("s_nationkey") * 1.0, i % 90 + 0.5, F.col("s_nationkey") + 1.0, i % 90 + 1.5)
    rules = F.concat(
        F.lit('[{"name": "'), "s_name", F.lit('", "bbox": '), box, F.lit('}, {"block": true, "bbox": '), box,
        F.when(i % 3 == 0, '}, {"name": "bad", "bbox": [1, 2, 3]}]').otherwise('}, {"bbox": null, "name": "none"}]'),
    )
    return views.table(spark, sf, "supplier").select(i.alias("file"), F.when(i % 2 == 0, F.concat(F.lit('{"areas": '), rules, F.lit("}"))).otherwise(rules).alias("text"))


@query("SRC-12", sql="""SELECT s_suppkey AS file, o::INT AS ordinal, CASE WHEN o = 0 THEN s_name END AS name, o = 1 AS block, s_nationkey * 1.0::DOUBLE AS lat_min, s_suppkey % 90 + 0.5::DOUBLE AS lng_min, s_nationkey + 1.0::DOUBLE AS lat_max, s_suppkey % 90 + 1.5::DOUBLE AS lng_max FROM supplier, (VALUES (0), (1)) v(o)""")
def alias_rules(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.sources.rules import parse_rules

    return parse_rules(alias_files(spark, sf), ["file"])
