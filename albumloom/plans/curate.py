"""Replies, retries, applied decisions, removal lists, tokens and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.functions import replies as rp
from albumloom.operators import curation, duplicates, naming, progress
from albumloom.params import Curation
from albumloom.plans import views
from albumloom.plans.oracle import ANSWERS, CALLS, DECISIONS, EVENTS_BY_TAG, NUMBERED, PHOTOS, REPLY_ITEMS, SENT, THEMES, copies_sql, with_
from albumloom.plans.photo_core import GROUPS, MATCHES, NODES
from albumloom.plans.registry import query
from albumloom.session import settle


@query("JSN-1", sql=with_(DECISIONS, REPLY_ITEMS, body='SELECT batch_id, "at", photo_id, is_highlight, reason, event_tag FROM answered'))
def reply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return rp.decision_items(views.replies(spark, sf), ["batch_id"])


@query("FIL-5", sql=with_(DECISIONS, REPLY_ITEMS, body="SELECT batch_id, photo_id AS item_id, is_highlight, reason, event_tag FROM answered WHERE doc_id % 5 <> 0"))
def valid_replies(spark: SparkSession, sf: str) -> DataFrame:
    parsed = rp.decision_items(views.replies(spark, sf), ["batch_id"])
    return curation.valid_items(parsed, views.sent(spark, sf).where("doc_id % 5 != 0"), ["batch_id"])


@query("JOIN-7", sql=with_(DECISIONS, REPLY_ITEMS, SENT, body="SELECT s.batch_id, item_id, is_highlight, path, t, is_exact FROM answered a JOIN sent s ON s.batch_id = a.batch_id AND s.item_id = a.photo_id"))
def decision_files(spark: SparkSession, sf: str) -> DataFrame:
    parsed = rp.decision_items(views.replies(spark, sf), ["batch_id"]).withColumnRenamed("photo_id", "item_id")
    return curation.with_files(parsed, views.sent(spark, sf)).select("batch_id", "item_id", "is_highlight", "path", "t", "is_exact")


@query("JOIN-8", sql=with_(DECISIONS, REPLY_ITEMS, SENT, body="SELECT batch_id, item_id FROM sent WHERE item_id NOT IN (SELECT photo_id FROM answered)"))
def unanswered(spark: SparkSession, sf: str) -> DataFrame:
    parsed = rp.decision_items(views.replies(spark, sf), ["batch_id"]).select("batch_id", F.col("photo_id").alias("item_id"))
    return views.sent(spark, sf).join(parsed, ["batch_id", "item_id"], "left_anti").select("batch_id", "item_id")


LINE = "'照片编号: ' || item_id || '，时间: ' || strftime(make_timestamp(t * 1000000), '%H:%M:%S') || CASE WHEN coalesce(place, '') <> '' THEN '，地点: ' || place ELSE '' END"


@query("JSN-5", sql=with_(SENT, body=f"SELECT batch_id, string_agg({LINE}, chr(10) ORDER BY rank) AS lines FROM sent GROUP BY batch_id"))
def request_texts(spark: SparkSession, sf: str) -> DataFrame:
    return curation.requests(views.sent(spark, sf), ["batch_id"], curation.photo_line()).select("batch_id", "lines")


@query("JSN-5", sql=with_(THEMES, NUMBERED, body="""SELECT chunk, string_agg(number || '. ' || tag || '（' || photo_count || ' 张）', chr(10) ORDER BY number) AS lines FROM numbered GROUP BY chunk"""))
def event_list_texts(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.col("number").cast("string"), F.lit(". "), "tag", F.lit("（"), F.col("photo_count").cast("string"), F.lit(" 张）"))
    rows = views.theme_requests(spark, sf).select("chunk", F.col("number").alias("rank"), F.col("tag").alias("item_id"), line.alias("text"))
    return curation.requests(rows, ["chunk"], F.col("text")).select("chunk", "lines")


@query("OPS-5", "UDF-1", sql=with_(SENT, ANSWERS, body="SELECT batch_id, item_id, is_highlight, reason FROM answers WHERE tier = 'T1'"))
def batch_inference(spark: SparkSession, sf: str) -> DataFrame:
    return curation.ask(views.sent(spark, sf), curation.sample_scorer, "T1", ["batch_id"]).select("batch_id", "item_id", "is_highlight", "reason")


@query("OPS-6", sql=with_(SENT, ANSWERS, body="SELECT batch_id, item_id, tier, CASE WHEN tier <> 'failed' THEN is_highlight END AS is_highlight FROM answers"))
def three_tier_retry(spark: SparkSession, sf: str) -> DataFrame:
    got, failed = curation.three_tiers(views.sent(spark, sf), curation.sample_scorer)
    return got.select("batch_id", "item_id", "tier", "is_highlight").unionByName(
        failed.select("batch_id", "item_id", F.lit("failed").alias("tier"), F.lit(None).cast("boolean").alias("is_highlight"))
    )


def failing_scorer(fatal_tier: str):
    """The stand-in model with calls that fail: an eighth of all, and some of one tier for good."""

    def run(pdf):
        from hashlib import md5

        out = curation.sample_scorer(pdf)
        for i, (key, tier) in enumerate(zip(pdf["key"], pdf["tier"])):
            d = md5((tier + "call" + key.replace("\u0001", "/")).encode()).hexdigest()[:2]
            if tier == fatal_tier and d < "06":
                out.loc[i, ["reply", "finish_reason"]] = ["Error code: 401 - unauthorized", "error"]
            elif d >= "e0":
                out.loc[i, ["reply", "finish_reason"]] = ["Connection reset by peer", "error"]
        return out

    return run


def guarded_sql(fatal_tier: str) -> list[str]:
    """All three tiers as if nothing stopped them, the first call that trips, and what comes before it."""
    call = lambda tier, key: f"substr(md5('{tier}call' || {key}), 1, 2)"
    bad = lambda tier, key: f"({call(tier, key)} >= 'e0'" + (f" OR {call(tier, key)} < '06')" if tier == fatal_tier else ")")
    fatal = lambda tier, key: f"{call(tier, key)} < '06'" if tier == fatal_tier else "false"
    return [
        f"""one AS (SELECT *, NOT {bad('T1', 'batch_id')} AND substr(md5('T1' || item_id), 1, 1) NOT IN ('0', '1', '2') AS a1 FROM sent),
two AS (SELECT *, NOT a1 AND NOT {bad('T2', 'batch_id')} AND substr(md5('T2' || item_id), 1, 1) > '7' AS a2 FROM one),
third AS (SELECT *, (row_number() OVER (PARTITION BY batch_id ORDER BY rank) - 1) // 2 AS sub FROM two WHERE NOT a1 AND NOT a2),
three AS (SELECT *, NOT {bad('T3', "batch_id || '/' || sub")} AND substr(md5('T3' || item_id), 1, 1) > '3' AS a3 FROM third),
calls3 AS (SELECT DISTINCT batch_id, 1 AS step, 0::BIGINT AS sub, NOT {bad('T1', 'batch_id')} AS ok, {fatal('T1', 'batch_id')} AS fatal FROM sent
  UNION ALL SELECT DISTINCT batch_id, 2, 0, NOT {bad('T2', 'batch_id')}, {fatal('T2', 'batch_id')} FROM one WHERE NOT a1
  UNION ALL SELECT DISTINCT batch_id, 3, sub, NOT {bad('T3', "batch_id || '/' || sub")}, {fatal('T3', "batch_id || '/' || sub")} FROM third),
rowed AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY batch_id, step, sub) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS streak FROM (SELECT *, count(*) FILTER (ok) OVER (ORDER BY batch_id, step, sub) AS island FROM calls3)),
trip AS (SELECT coalesce(min((batch_id, step, sub)) FILTER (fatal OR (NOT ok AND streak >= 5)), ('~', 9, 9::BIGINT)) AS at_, coalesce(min(batch_id) FILTER (fatal OR (NOT ok AND streak >= 5)), '~') AS b FROM rowed),
told AS (SELECT t.batch_id, t.item_id, CASE WHEN t.a1 THEN 'T1' WHEN t.a2 THEN 'T2' WHEN h.a3 THEN 'T3' END AS tier, CASE WHEN t.a1 THEN (t.batch_id, 1, 0::BIGINT) WHEN t.a2 THEN (t.batch_id, 2, 0::BIGINT) WHEN h.a3 THEN (t.batch_id, 3, h.sub) END AS by_ FROM two t LEFT JOIN three h USING (item_id))""",
    ]


GUARDED_BODY = "SELECT batch_id, item_id, CASE WHEN tier IS NOT NULL AND by_ < at_ THEN tier WHEN batch_id < b THEN 'failed' ELSE 'not_asked' END AS state FROM told, trip"


@query("OPS-6", sql=with_(SENT, *guarded_sql("T1"), body=GUARDED_BODY))
def retry_until_first_tier_fails(spark: SparkSession, sf: str) -> DataFrame:
    """Three tiers with the breaker, fatal failures in the first."""
    return curation.guarded_tiers(views.sent(spark, sf), failing_scorer("T1"))[0].select("batch_id", "item_id", "state")


@query("OPS-6", sql=with_(SENT, *guarded_sql("T2"), body=GUARDED_BODY))
def retry_until_second_tier_fails(spark: SparkSession, sf: str) -> DataFrame:
    """Three tiers with the breaker, fatal failures in the second."""
    return curation.guarded_tiers(views.sent(spark, sf), failing_scorer("T2"))[0].select("batch_id", "item_id", "state")


def cut_short_scorer(pdf):
    """Repeatable stand-in that breaks off a quarter of the first and a sixteenth of the second answers."""
    from hashlib import md5

    import pandas as pd

    out = []
    for key, attempt in zip(pdf["key"], pdf["attempt"]):
        d = md5(key.encode()).hexdigest()[0]
        cut = d < "4" if attempt == 1 else d == "0"
        out.append((key, "" if cut and d == "1" else f'{{"should_merge": true, "merged_name": "日{d}"', "length" if cut and d != "1" else "stop", 9))
        if not cut:
            out[-1] = (key, f'{{"should_merge": true, "merged_name": "日{d}", "reason": "a{attempt}"}}', "stop", 9)
    return pd.DataFrame(out, columns=["key", "reply", "finish_reason", "output_tokens"])


@query("OPS-7", "JSN-2", sql=with_(EVENTS_BY_TAG, body="""SELECT day AS key, CASE WHEN d < '4' THEN 2 ELSE 1 END AS attempts, CASE WHEN d <> '0' THEN '日' || d END AS merged_name, CASE WHEN d <> '0' THEN 'a' || CASE WHEN d < '4' THEN 2 ELSE 1 END END AS reason
  FROM (SELECT DISTINCT day, substr(md5(day), 1, 1) AS d FROM events_by_tag)"""))
def truncation_retry(spark: SparkSession, sf: str) -> DataFrame:
    days = views.event_dirs(spark, sf).select(F.col("day").alias("key")).distinct()
    got = curation.retry_truncated(days, cut_short_scorer)
    return rp.merge_decision(got, ["key", "attempts"]).select("key", "attempts", "decision.merged_name", "decision.reason")


@query("JSN-2", sql="""SELECT doc_id, k NOT IN (2, 3) AS parsed, CASE WHEN k NOT IN (2, 3) THEN k IN (0, 5) END AS should_merge,
   CASE k WHEN 0 THEN '家庭日' WHEN 4 THEN source WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '' END AS merged_name, CASE k WHEN 0 THEN '近' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '' END AS reason FROM (SELECT *, doc_id % 6 AS k FROM documents)""")
def merge_replies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 6
    text = (
        F.when(k == 0, '{"should_merge": true, "merged_name": " 家庭日 ", "reason": "近"}').when(k == 1, '```json\n{"should_merge": false, "reason": null}\n```').when(k == 2, "sorry")
        .when(k == 3, "[1]").when(k == 4, F.concat(F.lit('{"merged_name": "'), "source", F.lit('"}'))).otherwise('{"should_merge": true}')
    )
    d = rp.merge_decision(views.table(spark, sf, "documents").select("doc_id", text.alias("reply")), ["doc_id"])
    return d.select("doc_id", F.col("decision").isNotNull().alias("parsed"), "decision.should_merge", "decision.merged_name", "decision.reason")


@query("JSN-3", sql=with_(THEMES, NUMBERED, body="""SELECT chunk, theme, CASE WHEN chunk % 3 <> 2 THEN number::INT END AS number, CASE WHEN chunk % 3 = 2 THEN tag END AS tag FROM numbered
  UNION ALL SELECT DISTINCT chunk, theme, 9999, NULL FROM numbered"""))
def theme_reply_items(spark: SparkSession, sf: str) -> DataFrame:
    return rp.theme_items(views.theme_replies(views.theme_requests(spark, sf)), ["chunk"])


@query("JSN-4", sql="""SELECT name || '主题' AS theme, name || '合并' AS merged FROM (SELECT DISTINCT substr(o_orderpriority, 3, 20) AS name FROM orders) WHERE name <> 'LOW'
  UNION ALL SELECT name || '记录', name || '合并' FROM (SELECT DISTINCT substr(o_orderpriority, 3, 20) AS name FROM orders) WHERE name <> 'LOW'""")
def theme_merge_map(spark: SparkSession, sf: str) -> DataFrame:
    return rp.merge_map(views.merge_replies(spark, sf), views.themes(spark, sf))


def raw_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with the odd tags models give."""
    i = F.col("doc_id")
    tag = F.when(i % 5 == 0, "").when(i % 5 == 1, " NULL ").when(i % 5 == 2, F.concat("day", F.lit("-公园 a/b"))).when(i % 5 == 3, F.concat(F.lit("-"), "day", F.lit("-晚餐"))).otherwise("骑行")
    return views.sent(spark, sf).select("doc_id", "batch_id", "item_id", "day", (i % 3 != 0).alias("is_highlight"), F.when(i % 4 == 0, "无").otherwise("好").alias("reason"), tag.alias("event_tag"))


RAW = SENT + """, raw AS (SELECT *, doc_id % 3 <> 0 AS is_highlight, CASE WHEN doc_id % 4 = 0 THEN '无' ELSE '好' END AS reason,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' NULL ' WHEN 2 THEN day || '-公园 a/b' WHEN 3 THEN '-' || day || '-晚餐' ELSE '骑行' END AS event_tag FROM sent)"""


@query("FIL-6", sql=with_(RAW, body="""SELECT item_id, false AS forced, NOT is_highlight AS rejected, is_highlight AND doc_id % 5 > 1 AS kept, event_tag, reason FROM raw
  UNION ALL SELECT item_id, true, NOT is_highlight, true, CASE WHEN doc_id % 5 < 2 THEN day || '-未分类' ELSE event_tag END, CASE WHEN doc_id % 5 < 2 AND reason = '无' THEN '归类档兜底' ELSE reason END FROM raw"""))
def keep_override(spark: SparkSession, sf: str) -> DataFrame:
    d = raw_decisions(spark, sf)
    cols = ["item_id", "forced", "rejected", "kept", "event_tag", "reason"]
    plain = curation.overridden(d).withColumn("forced", F.lit(False)).select(*cols)
    return plain.unionByName(curation.overridden(d, Curation(force_keep=True)).withColumn("forced", F.lit(True)).select(*cols))


DEST = """CASE doc_id % 5 WHEN 2 THEN day || '-公园a、b' WHEN 3 THEN day || '-晚餐' ELSE day || '-骑行' END"""
PLAN = f"""wanted AS (SELECT {DEST} AS folder, 'IMG_' || (doc_id % 40) || CASE WHEN is_exact THEN '' ELSE '_NoEXIF' END || '.jpg' AS name, path AS src FROM raw WHERE is_highlight AND doc_id % 5 > 1),
planned AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY src) AS rn FROM wanted)"""


@query("OPS-8", "SNK-8", sql=with_(RAW, PLAN, body="""SELECT folder, name, src, CASE WHEN rn = 1 THEN name ELSE replace(name, '.jpg', '_' || substr(md5(src), 1, 8) || '.jpg') END AS final_name,
   CASE WHEN rn = 1 THEN 'copied' ELSE 'copied_hashed' END AS status FROM planned"""))
def applied_decisions(spark: SparkSession, sf: str) -> DataFrame:
    plan, _ = curation.apply_decisions(raw_decisions(spark, sf).drop("day"), views.sent(spark, sf))
    return plan


@query("OPS-8", "SNK-8", sql=with_(RAW, PLAN.split(",\nplanned")[0], *copies_sql("wanted", numbered=False), body="SELECT folder, name, src, final_name, status FROM copies"))
def applied_to_target(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions applied where files are there already: equal files are left, a digest name of another file is a conflict."""
    plan, _ = applied_with_target(raw_decisions(spark, sf).drop("day"), views.sent(spark, sf))
    return plan.select("folder", "name", "src", "final_name", "status")


def applied_with_target(decisions: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, target) over a target made from the wanted names."""
    items = sent.withColumns(views.content_of(F.col("path")))
    wanted, _ = curation.apply_decisions(decisions, items)
    wanted = wanted.select("folder", "name", "src").withColumns(views.content_of(F.col("src")))
    target = settle(views.copy_target(wanted, F.lit("")))
    return curation.apply_decisions(decisions, items, target=target)[0], target


@query("OPS-8", "SNK-8", sql=with_(RAW, PLAN.split(",\nplanned")[0], *copies_sql("wanted", numbered=False),
  body="SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'conflict' THEN status ELSE 'exists_same' END AS status FROM copies) GROUP BY status"))
def applied_again(spark: SparkSession, sf: str) -> DataFrame:
    """A second run over what the first one left in the target: nothing is copied."""
    decisions, sent = raw_decisions(spark, sf).drop("day"), views.sent(spark, sf)
    plan, target = applied_with_target(decisions, sent)
    items = sent.withColumns(views.content_of(F.col("path")))
    again, _ = curation.apply_decisions(decisions, items, target=settle(naming.listing(settle(plan), target)))
    return again.groupBy("status").agg(F.count("*").alias("n"))


@query("OPS-8", sql=with_(RAW, body="SELECT 'IMG_' || (doc_id % 40) || '.jpg' AS name, t AS epoch FROM raw WHERE NOT is_highlight"))
def rejected_photos(spark: SparkSession, sf: str) -> DataFrame:
    _, gone = curation.apply_decisions(raw_decisions(spark, sf).drop("day"), views.sent(spark, sf))
    return gone


@query("WIN-6", "SNK-8", sql="""SELECT folder, name, src, CASE WHEN first_c = c THEN name WHEN again = 1 THEN alt || '.jpg' ELSE alt || '_' || again || '.jpg' END AS final_name,
    CASE WHEN rn = 1 THEN 'copied' WHEN first_c = c THEN 'exists_same' ELSE 'copied_hashed' END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY folder, alt, first_c = c ORDER BY src) AS again FROM (
    SELECT *, replace(name, '.jpg', '_' || strftime(d, '%Y%m%d') || '_' || substr(md5(src), 1, 8)) AS alt, row_number() OVER w AS rn, first_value(c) OVER w AS first_c FROM (
      SELECT 'p' || (l_partkey % 50) AS folder, 'IMG_' || (l_suppkey % 10) || '.jpg' AS name, '/phone/' || l_orderkey || '/' || l_linenumber || '/' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS src, (l_quantity::INT % 4)::VARCHAR AS c, l_shipdate AS d FROM lineitem)
    WINDOW w AS (PARTITION BY folder, name ORDER BY src)))""")
def conflict_names(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    f = views.table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("folder"), F.concat(F.lit("IMG_"), F.col("l_suppkey") % 10, F.lit(".jpg")).alias("name"),
        F.concat(F.lit("/phone/"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit("/"), nth).alias("src"),
        (F.col("l_quantity").cast("int") % 4).cast("string").alias("c"), F.date_format("l_shipdate", "yyyyMMdd").alias("d"),
    )
    return naming.plan_copies(f, mark=F.col("d"), same="c").select("folder", "name", "src", "final_name", "status")


@query("WIN-6", sql="""SELECT c_custkey, folder, CASE WHEN rn = 1 THEN folder ELSE folder || '_v' || rn END AS final_folder FROM (
  SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS folder, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS rn FROM customer)""")
def folder_versions(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("-"), "c_nationkey").alias("folder"))
    return naming.plan_folders(c, "folder", ["c_custkey"])


COPIES = [PHOTOS, NODES, MATCHES, GROUPS, "gone AS (SELECT g.* FROM grouped g JOIN kept k USING (group_id) WHERE g.photo_id <> k.photo_id)"]


@query("JOIN-9", sql=with_(*COPIES, recursive=True, body="SELECT filename AS name, -1::BIGINT AS epoch, 'compat' AS mode FROM gone UNION ALL SELECT filename, t, 'exact' FROM gone"))
def copy_times(spark: SparkSession, sf: str) -> DataFrame:
    ph = views.photos(spark, sf)
    grouped = duplicates.duplicate_groups(ph)
    gone = duplicates.dropped(grouped).select("path", "filename")
    # compat looks among the photos left after removal, where a removed copy never is; exact looks among all
    compat = curation.copy_times(gone, duplicates.keepers(grouped).select("path", "t")).withColumn("mode", F.lit("compat"))
    return compat.unionByName(curation.copy_times(gone, ph.select("path", "t")).withColumn("mode", F.lit("exact")))


@query("SET-1", "SNK-2", "SORT-3", sql=with_(RAW, *COPIES, recursive=True, body="""SELECT DISTINCT name || '|' || epoch AS line FROM (
   SELECT 'IMG_' || (doc_id % 40) || '.jpg' AS name, t AS epoch FROM raw WHERE NOT is_highlight UNION ALL SELECT filename, -1 FROM gone) UNION ALL SELECT '#MATCH_MODE=DATETIME'"""))
def removal_lines(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.sources.lists import removal_text

    ph = views.photos(spark, sf)
    grouped = settle(duplicates.duplicate_groups(ph))
    copies = curation.copy_times(duplicates.dropped(grouped).select("path", "filename"), duplicates.keepers(grouped).select("path", "t"))
    copies = settle(copies)  # the order over the whole list reads it twice
    return removal_text(curation.removal_list(rejected_photos(spark, sf), copies))


@query("SNK-9", sql=with_(SENT, ANSWERS, body="SELECT 'IMG_' || (doc_id % 40) || '.jpg' AS name, min(path) AS path FROM answers WHERE tier = 'failed' GROUP BY 1"))
def failed_archive(spark: SparkSession, sf: str) -> DataFrame:
    _, failed = curation.three_tiers(views.sent(spark, sf), curation.sample_scorer)
    return curation.failed_files(failed)


@query("AGG-7", sql=with_(CALLS, body="""SELECT tier, count(*) AS calls, sum(greatest(prompt_tokens - cached_tokens, 0))::BIGINT AS fresh, sum(cached_tokens)::BIGINT AS cached, sum(output_tokens)::BIGINT AS output, sum(prompt_tokens)::BIGINT AS tier_input
   FROM calls GROUP BY ROLLUP (tier)"""))
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    return curation.token_totals(views.calls(spark, sf))


PRICE_ROWS = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, '{u}')" for m, a, b, c, u in curation.PRICES)
MODELS = "[" + ", ".join(f"'{m[0]}'" for m in curation.PRICES) + ", 'unlisted']"


@query("AGG-8", "UDF-2", sql=with_(CALLS, f"prices(model, i, c, o, currency) AS (VALUES {PRICE_ROWS})", body=f"""SELECT model, currency, round(fresh / 1000000 * i, 4) AS cost_input, round(cached / 1000000 * c, 4) AS cost_cached, round(output / 1000000 * o, 4) AS cost_output,
    round(fresh / 1000000 * i + cached / 1000000 * c + output / 1000000 * o, 4) AS cost_total
  FROM (SELECT {MODELS}[(run % 12 + 1)::INT] AS model, sum(greatest(prompt_tokens - cached_tokens, 0))::DOUBLE AS fresh, sum(cached_tokens)::DOUBLE AS cached, sum(output_tokens)::DOUBLE AS output FROM calls GROUP BY 1) LEFT JOIN prices USING (model)"""))
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(m[0]) for m in curation.PRICES], F.lit("unlisted"))
    calls = views.calls(spark, sf).withColumn("model", F.element_at(names, (F.col("run") % 12 + 1).cast("int")))
    prices = spark.createDataFrame(curation.PRICES, "model string, input_price double, cached_price double, output_price double, currency string")
    return curation.cost_estimate(calls, prices)


@query("AGG-9", sql=with_(CALLS, body="""SELECT run, round(sum(greatest(prompt_tokens - cached_tokens, 0))::DOUBLE / count(*), 4) AS fresh_per_call, round(sum(cached_tokens)::DOUBLE / count(*), 4) AS cached_per_call,
   round(sum(output_tokens)::DOUBLE / count(*), 4) AS output_per_call, round(count(*) / nullif((max(t) - min(t)) / 60.0::DOUBLE, 0), 6) AS calls_per_minute FROM calls GROUP BY run"""))
def run_performance(spark: SparkSession, sf: str) -> DataFrame:
    return curation.run_performance(views.calls(spark, sf))


@query("WIN-10", sql=with_(CALLS, body="""SELECT run, t, done, recent, round(recent / least(age, 300.0::DOUBLE) * 60.0::DOUBLE, 6) AS recent_per_minute, round(done / age * 60.0::DOUBLE, 6) AS average_per_minute,
    round(greatest(total - done, 0) / (done / age), 4) AS eta_seconds, round(done * 100.0::DOUBLE / total, 4) AS percent
  FROM (SELECT DISTINCT run, t, count(*) OVER (PARTITION BY run ORDER BY t RANGE UNBOUNDED PRECEDING) AS done, count(*) OVER (PARTITION BY run ORDER BY t RANGE 300 PRECEDING) AS recent,
          (t - min(t) OVER (PARTITION BY run))::DOUBLE AS age, total FROM calls JOIN (SELECT run, count(*) AS total FROM calls GROUP BY run) USING (run) WHERE ok) WHERE age > 0"""))
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    c = views.calls(spark, sf)
    return progress.throughput(c.where("ok"), c.groupBy("run").agg(F.count("*").alias("total")))


@query("WIN-11", sql=with_(CALLS, body="""SELECT run, call_id, streak, streak >= 5 AS tripped FROM (
   SELECT run, call_id, ok, row_number() OVER (PARTITION BY run, island ORDER BY t, call_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS streak FROM (
     SELECT *, count(*) FILTER (ok) OVER (PARTITION BY run ORDER BY t, call_id) AS island FROM calls)) WHERE NOT ok"""))
def failure_runs(spark: SparkSession, sf: str) -> DataFrame:
    return progress.failure_runs(views.calls(spark, sf))


@query("WIN-12", sql="SELECT o_orderkey AS task_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'")
def queue_places(spark: SparkSession, sf: str) -> DataFrame:
    q = views.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("entered"))
    return progress.queue_places(q)
