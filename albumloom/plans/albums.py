"""Event folders, days, themes, periods, ledgers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.operators import progress, themes
from albumloom.params import Themes
from albumloom.plans import views
from albumloom.plans.oracle import EVENT_DIRS, EVENT_FILES, EVENTS_BY_TAG, NUMBERED, RENAMES, THEMES, copies_sql, with_
from albumloom.plans.registry import query
from albumloom.session import settle
from albumloom.sources import folders

FLAT = EVENT_FILES + r""", ev AS (
  SELECT split_part(path, '/', 3) AS tag, path, regexp_matches(lower(path), '\.(jpg|jpeg|png)$') AS pic FROM event_files WHERE regexp_matches(split_part(path, '/', 3), '^\d{4}-\d{2}-\d{2}-.+$')),
flat AS (SELECT tag, substr(tag, 1, 10) AS day, substr(tag, 12) AS event_name, count(*) FILTER (pic) AS photo_count, min(path) FILTER (pic) AS first_photo, max(path) FILTER (pic) AS last_photo,
   bool_or(path = '/archive/' || tag || '/manifest.json') AS has_manifest FROM ev GROUP BY tag)"""


@query("SRC-3", sql=with_(FLAT, body="SELECT tag, day, event_name, photo_count, first_photo, last_photo, has_manifest FROM flat"))
def event_folders(spark: SparkSession, sf: str) -> DataFrame:
    return folders.flat_events(views.event_files(spark, sf), "/archive")


@query("SRC-4", sql=with_(EVENT_DIRS, body="""SELECT '/b' AS root, grp, CASE WHEN grp = min(grp) OVER (PARTITION BY folder) THEN folder ELSE grp || '_' || folder END AS tag, day, year, event_name, photo_count
    FROM event_dirs WHERE grp <> 'BUILDING'
  UNION ALL SELECT '/a', NULL, folder, day, year, event_name, sum(photo_count)::BIGINT FROM event_dirs GROUP BY folder, day, year, event_name"""))
def layered_event_folders(spark: SparkSession, sf: str) -> DataFrame:
    o, c = views.table(spark, sf, "orders"), views.table(spark, sf, "customer")
    tag = F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("-"), F.substring("o_orderpriority", 3, 20))
    rows = o.join(c, o.o_custkey == c.c_custkey).select(tag.alias("tag"), "c_mktsegment", "o_orderkey")
    file = F.concat(F.lit("/IMG_"), "o_orderkey", F.lit(".jpg"))
    flat = rows.select(F.lit("/a").alias("root"), F.concat(F.lit("/a/"), "tag", file).alias("path"))
    aside = rows.select(F.lit("/a").alias("root"), F.concat(F.lit("/a/"), "c_mktsegment", F.lit("/"), "tag", file).alias("path"))
    group = F.when(F.col("c_mktsegment") == "BUILDING", "_hidden").otherwise(F.col("c_mktsegment"))
    deep = rows.select(F.lit("/b").alias("root"), F.concat(F.lit("/b/"), group, F.lit("/"), "tag", file).alias("path"))
    return folders.layered_events(flat.unionByName(aside).unionByName(deep))


ARCHIVE = FLAT + """, arch AS (SELECT substr(tag, 1, 4) AS year, substr(tag, 6, 2) AS month, substr(tag, 1, 10) AS day, path FROM ev WHERE pic)"""


@query("SRC-5", sql=with_(ARCHIVE, body="SELECT year, month, day, path FROM arch"))
def archive_photos(spark: SparkSession, sf: str) -> DataFrame:
    return folders.archive_photos(views.event_files(spark, sf), "/archive")


@query("SRC-5", sql=with_(EVENT_FILES, body="SELECT DISTINCT split_part(path, '/', 3) AS folder FROM event_files WHERE split_part(path, '/', 3) = 'misc'"))
def odd_folders(spark: SparkSession, sf: str) -> DataFrame:
    return folders.odd_folders(views.event_files(spark, sf), "/archive")


@query("FIL-8", sql=with_(FLAT, body="""SELECT day, count(*) AS events, sum(photo_count)::BIGINT AS photos, CASE WHEN count(*) > 1 THEN 'multi' WHEN bool_or(has_manifest) THEN 'merged' ELSE 'single' END AS class FROM flat GROUP BY day"""))
def day_classes(spark: SparkSession, sf: str) -> DataFrame:
    return themes.day_classes(event_folders(spark, sf))


@query("AGG-10", sql=with_(EVENT_DIRS, body="SELECT DISTINCT day, folder AS tag FROM event_dirs"))
def event_pool(spark: SparkSession, sf: str) -> DataFrame:
    return views.event_dirs(spark, sf).select("day", F.col("folder").alias("tag")).distinct()


@query("AGG-11", sql=with_(EVENT_DIRS, body="""SELECT day, count(*) || ' 个事件 / ' || sum(photo_count) || ' 张照片 [' || string_agg(event_name, ', ' ORDER BY rn) FILTER (rn <= 5) || CASE WHEN count(*) > 5 THEN ' 等 ' || count(*) || ' 个' ELSE '' END || ']' AS brief
  FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY folder || '/' || grp) AS rn FROM event_dirs) GROUP BY day"""))
def day_brief(spark: SparkSession, sf: str) -> DataFrame:
    e = views.event_dirs(spark, sf).withColumn("tag", F.concat("folder", F.lit("/"), "grp"))
    return themes.day_brief(e)


@query("AGG-12", sql=with_(EVENTS_BY_TAG, body="""SELECT count(*) AS events, coalesce(bit_xor(v), 0)::BIGINT AS mix, coalesce(sum(v % 1000000007), 0)::BIGINT AS mark
  FROM (SELECT ('0x' || substr(md5(tag || '|' || photo_count), 1, 15))::BIGINT AS v FROM events_by_tag)"""))
def event_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return themes.fingerprint(views.events_by_tag(spark, sf))


@query("WIN-9", sql=with_(THEMES, NUMBERED, body="SELECT tag, chunk, number FROM numbered"))
def numbered_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return progress.chunked(views.themes(spark, sf), [], ["tag"], 100).select("tag", "chunk", "number")


@query("JOIN-15", sql=with_(THEMES, NUMBERED, body="SELECT theme, tag FROM numbered"))
def theme_members(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.functions.replies import theme_items

    numbered = views.theme_requests(spark, sf)
    return themes.decode_members(theme_items(views.theme_replies(numbered), ["chunk"]), numbered)


@query("AGG-13", "SORT-3", sql=with_(THEMES, body="SELECT theme, tag, count(*) OVER (PARTITION BY theme) AS theme_size FROM themes"))
def united_themes(spark: SparkSession, sf: str) -> DataFrame:
    t = views.themes(spark, sf)
    return themes.united(t.unionByName(t.where("photo_count > 1"))).orderBy(F.desc("theme_size"), "theme", "tag")


@query("JOIN-16", sql=with_(THEMES, RENAMES, body="SELECT coalesce(merged, theme) AS theme, tag FROM themes LEFT JOIN renames USING (theme)"))
def renamed_themes(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.functions.replies import merge_map

    t = views.themes(spark, sf)
    return themes.renamed(t, merge_map(views.merge_replies(spark, sf), t))


YEARLY = EVENTS_BY_TAG + """, yearly AS (SELECT event_name || '-' || substr(day, 6) AS theme, tag, year, photo_count FROM events_by_tag)"""


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """The same name on the same calendar day of different years."""
    return views.events_by_tag(spark, sf).withColumn("theme", F.concat("event_name", F.lit("-"), F.substring("day", 6, 5)))


SUMMARY = """summary AS (SELECT theme, count(*) AS events, sum(photo_count)::BIGINT AS photos, string_agg(DISTINCT year, ',' ORDER BY year) AS years, count(DISTINCT year) AS n_years, min(year) AS a, max(year) AS b FROM {} GROUP BY theme)"""


@query("AGG-14", sql=with_(YEARLY, SUMMARY.format("yearly"), body="SELECT theme, events, photos, years FROM summary"))
def theme_summary(spark: SparkSession, sf: str) -> DataFrame:
    y = yearly(spark, sf)
    return themes.theme_summary(y.select("theme", "tag"), y).withColumn("years", F.array_join("years", ","))


@query("FIL-7", "SCL-20", sql=with_(YEARLY, SUMMARY.format("yearly"), body="SELECT theme, events, CASE WHEN a = b THEN a ELSE a || '-' || b END || '-' || replace(theme, ' ', '') AS theme_folder FROM summary WHERE events >= 5 AND n_years - 1 >= 4"))
def eligible_themes(spark: SparkSession, sf: str) -> DataFrame:
    y = yearly(spark, sf)
    return themes.eligible(themes.theme_summary(y.select("theme", "tag"), y), Themes(min_events=5, min_year_span=4)).select("theme", "events", "theme_folder")


@query("SET-2", "SNK-5", sql=with_(YEARLY, SUMMARY.format("yearly"), body="""SELECT count(*) AS event_count, sum(photo_count)::BIGINT AS total_photos, string_agg(DISTINCT year, ',' ORDER BY year) AS years FROM yearly
   WHERE theme NOT IN (SELECT theme FROM summary WHERE events >= 5 AND n_years - 1 >= 4)"""))
def ungrouped_summary(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.sources.sinks import ungrouped_document

    y = yearly(spark, sf)
    members = y.select("theme", "tag")
    valid = themes.eligible(themes.theme_summary(members, y), Themes(min_events=5, min_year_span=4))
    return ungrouped_document(themes.ungrouped(y, members, valid)).withColumn("years", F.array_join("years", ","))


def sample_theme_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeatable stand-in for the grouping model: themes by event name and day."""
    out = []
    for key, ids in zip(pdf["key"], pdf["ids"]):
        got: dict[str, list[int]] = {}
        for n, tag in enumerate(ids, 1):
            day = int(tag[8:10])
            theme = "单次" + tag if day == 31 else tag[11:] + ("记录" if day % 7 == 0 else "主题")
            got.setdefault(theme, []).append(n)
        out.append((key, json.dumps([{"theme": t, "events": e} for t, e in got.items()], ensure_ascii=False), "stop", len(ids)))
    return pd.DataFrame(out, columns=["key", "reply", "finish_reason", "output_tokens"])


def clustered(spark: SparkSession, sf: str):
    return themes.cluster_themes(views.events_by_tag(spark, sf), sample_theme_scorer, views.merge_replies(spark, sf))


CLUSTER = [THEMES, RENAMES, "merged AS (SELECT coalesce(merged, theme) AS theme, tag, year, photo_count FROM themes LEFT JOIN renames USING (theme))", SUMMARY.format("merged"), "valid AS (SELECT *, CASE WHEN a = b THEN a ELSE a || '-' || b END || '-' || replace(theme, ' ', '') AS theme_folder FROM summary WHERE events >= 2 AND n_years >= 2)"]


@query("OPS-10", sql=with_(*CLUSTER, body="SELECT tag, theme_folder FROM merged LEFT JOIN valid USING (theme)"))
def theme_clustering(spark: SparkSession, sf: str) -> DataFrame:
    members, valid, rest = clustered(spark, sf)
    grouped = members.join(valid.select("theme", "theme_folder"), "theme").select("tag", "theme_folder")
    return grouped.unionByName(rest.select("tag", F.lit(None).cast("string").alias("theme_folder")))


@query("SNK-4", sql=with_(*CLUSTER, body="""SELECT theme, theme_folder, events, photos, years, (SELECT count(*) FROM events_by_tag) AS total_events, (sum(events) OVER ())::BIGINT AS grouped_events,
   (SELECT count(*) FROM merged WHERE theme NOT IN (SELECT theme FROM valid)) AS ungrouped_events FROM valid"""))
def theme_index(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.sources.sinks import theme_index as index

    _, valid, rest = clustered(spark, sf)
    return index(valid, rest, views.events_by_tag(spark, sf)).withColumn("years", F.array_join("years", ","))


def sample_merge_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeatable stand-in for the theme-merging model: two chained merges, one theme nobody has, one list cut off once."""
    out = []
    for key, ids, attempt in zip(pdf["key"], pdf["ids"], pdf["attempt"]):
        if attempt == 1:
            out.append((key, "", "length", 7))
            continue
        here = set(ids)
        merges = [{"merged_name": n + "记录", "themes": [n + "主题", "没有这个", n + "记录"]} for n in sorted({t[:-2] for t in here if t.endswith("主题") and t[:-2] + "记录" in here})]
        merges += [{"merged_name": "急", "themes": sorted(t for t in here if t[:-2] in ("URGENT", "HIGH") and t.endswith("记录"))}]
        out.append((key, "```json\n" + json.dumps({"merges": merges}, ensure_ascii=False) + "\n```", "stop", 9))
    return pd.DataFrame(out, columns=["key", "reply", "finish_reason", "output_tokens"])


# the names of both theme kinds of an event name become one; those of two event names go on to a common one
ASKED_NAMES = """asked AS (SELECT t.*, EXISTS (SELECT 1 FROM themes o WHERE o.theme = t.base || '主题') AND EXISTS (SELECT 1 FROM themes o WHERE o.theme = t.base || '记录') AS paired
  FROM (SELECT *, CASE WHEN theme LIKE '单次%' THEN theme ELSE left(theme, -2) END AS base FROM themes) t),
urgent AS (SELECT count(DISTINCT theme) > 1 AS joined FROM themes WHERE theme IN ('URGENT记录', 'HIGH记录')),
merged AS (SELECT CASE WHEN theme LIKE '单次%' THEN theme WHEN base IN ('URGENT', 'HIGH') AND joined AND (paired OR theme LIKE '%记录') THEN '急' WHEN paired THEN base || '记录' ELSE theme END AS theme, tag, year, photo_count FROM asked, urgent)"""
ASKED = [THEMES, ASKED_NAMES, SUMMARY.format("merged"), CLUSTER[-1]]


@query("JSN-5", sql=with_(THEMES, body="""SELECT count(*) AS themes, '【主题列表】（共 ' || count(*) || ' 个主题）：' || chr(10) || string_agg(n || '. ' || theme || '（' || events || ' 个事件）', chr(10) ORDER BY n) || chr(10) || chr(10) || '请把语义相同的主题合并，输出 JSON。' AS lines
   FROM (SELECT theme, count(*) AS events, row_number() OVER (ORDER BY count(*) DESC, theme) AS n FROM themes GROUP BY theme)"""))
def theme_list_text(spark: SparkSession, sf: str) -> DataFrame:
    """The request of the second pass, all themes in one list."""
    asked = themes.theme_requests(views.themes(spark, sf), Themes(theme_batch=1_000_000))
    return asked.select(F.size("ids").cast("bigint").alias("themes"), "lines")


@query("OPS-10", "JSN-5", sql=with_(*ASKED, body="SELECT tag, theme, theme_folder FROM merged LEFT JOIN valid USING (theme)"))
def theme_merging(spark: SparkSession, sf: str) -> DataFrame:
    """Both passes asked for, the second with a list cut off at first and chained renames."""
    members, valid, _ = themes.cluster_themes(views.events_by_tag(spark, sf), sample_theme_scorer, merge_scorer=sample_merge_scorer, p=Themes(theme_batch=1_000_000))
    return members.join(valid.select("theme", "theme_folder"), "theme", "left").select("tag", "theme", "theme_folder")


@query("OPS-10", "SNK-8", sql=with_(*ASKED, EVENT_FILES, r"pics AS (SELECT split_part(path, '/', 3) AS tag, path AS src FROM event_files WHERE regexp_matches(lower(path), '\.(jpg|jpeg|png)$'))",
  r"wanted AS (SELECT theme_folder || '/' || tag AS folder, regexp_extract(src, '[^/]*$') AS name, src, theme, tag FROM merged JOIN valid USING (theme) JOIN pics USING (tag))", *copies_sql("wanted"), body="SELECT folder, name, src, theme, tag, final_name, status FROM copies"))
def theme_copy_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Photos of valid themes into the folders of their events there, some of which hold files already."""
    members, valid, _ = themes.cluster_themes(views.events_by_tag(spark, sf), sample_theme_scorer, merge_scorer=sample_merge_scorer, p=Themes(theme_batch=1_000_000))
    pics = folders.event_photos(views.event_files(spark, sf), "/archive").select("tag", "path").withColumns(views.content_of(F.col("path")))
    wanted = themes.theme_copies(members, valid, pics).select("folder", "name", "src").withColumns(views.content_of(F.col("src")))
    plan = themes.theme_copies(members, valid, pics, settle(views.copy_target(wanted, F.lit(""))))
    return plan.select("folder", "name", "src", "theme", "tag", "final_name", "status")


def sample_day_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeatable stand-in for the day-merging model, by the first md5 digit of the day."""
    from hashlib import md5

    out = []
    for key in pdf["key"]:
        d = md5(key.encode()).hexdigest()[0]
        name = "" if d == "3" else "日" + d
        reply = "no json" if d == "f" else json.dumps({"should_merge": d < "8", "merged_name": name, "reason": "r" + d}, ensure_ascii=False)
        out.append((key, reply, "stop", 9))
    return pd.DataFrame(out, columns=["key", "reply", "finish_reason", "output_tokens"])


def merged_days(spark: SparkSession, sf: str):
    files = views.event_files(spark, sf)
    events = folders.flat_events(files, "/archive").where("photo_count > 0")
    return (*themes.merge_days(events, folders.event_photos(files, "/archive"), sample_day_scorer), events)


DAYS = [FLAT, "have AS (SELECT * FROM flat WHERE photo_count > 0)", """days AS (SELECT day, CASE WHEN d = 'f' THEN 'failed' WHEN d < '8' THEN 'merged' ELSE 'skipped' END AS state, nullif('r' || d, 'rf') AS reason,
   CASE WHEN d < '8' THEN day || '-' || CASE WHEN d = '3' THEN first_name ELSE '日' || d END || CASE WHEN d = '3' THEN '_v2' ELSE '' END END AS folder
   FROM (SELECT day, substr(md5(day), 1, 1) AS d, replace(arg_min(event_name, tag), ' ', '') AS first_name FROM have GROUP BY day HAVING count(*) > 1))""",
   """plan AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY src) AS rn FROM (
     SELECT days.day, ev.tag, folder, regexp_extract(path, '[^/]*$') AS name, path AS src FROM ev JOIN days ON days.day = substr(ev.tag, 1, 10) WHERE pic AND state = 'merged'))"""]
# a merged name that falls back on an event's own name meets that event's folder, unless cleaning changed it
DAYS[2] = DAYS[2].replace("CASE WHEN d = '3' THEN '_v2' ELSE '' END END", "CASE WHEN d = '3' AND raw = first_name THEN '_v2' ELSE '' END END").replace("AS first_name FROM have", "AS first_name, arg_min(event_name, tag) AS raw FROM have")


@query("OPS-9", sql=with_(*DAYS, body="SELECT day, state, reason, folder FROM days"))
def day_merge_states(spark: SparkSession, sf: str) -> DataFrame:
    return merged_days(spark, sf)[0]


@query("OPS-9", "SNK-8", sql=with_(*DAYS, body="""SELECT day, tag, folder, name, src, CASE WHEN rn = 1 THEN name ELSE regexp_replace(name, '(\\.[^.]*)$', '_' || substr(md5(src), 1, 8) || '\\1') END AS final_name, CASE WHEN rn = 1 THEN 'copied' ELSE 'copied_hashed' END AS status FROM plan"""))
def day_merge_plan(spark: SparkSession, sf: str) -> DataFrame:
    return merged_days(spark, sf)[1]


@query("OPS-9", "SNK-8", sql=with_(*DAYS, *copies_sql("(SELECT day, tag, folder, name, src FROM plan)"), body="SELECT day, tag, folder, name, src, final_name, status FROM copies"))
def day_merge_to_target(spark: SparkSession, sf: str) -> DataFrame:
    """The move plan where merged folders hold files already."""
    files = views.event_files(spark, sf)
    events = folders.flat_events(files, "/archive").where("photo_count > 0")
    photos = folders.event_photos(files, "/archive").withColumns(views.content_of(F.col("path")))
    _, wanted = themes.merge_days(events, photos, sample_day_scorer)
    wanted = wanted.select("folder", "name", "src").withColumns(views.content_of(F.col("src")))
    _, plan = themes.merge_days(events, photos, sample_day_scorer, target=settle(views.copy_target(wanted, F.lit(""))))
    return plan.select("day", "tag", "folder", "name", "src", "final_name", "status")


@query("SNK-3", sql=with_(*DAYS, body="""SELECT h.day, h.tag, h.photo_count, d.folder AS merged_name, d.reason, count(p.src) AS moved_count FROM have h JOIN days d USING (day) LEFT JOIN plan p ON p.tag = h.tag WHERE d.state = 'merged' GROUP BY ALL"""))
def day_manifest(spark: SparkSession, sf: str) -> DataFrame:
    days, plan, events = merged_days(spark, sf)
    return themes.day_manifest(days, plan, events)


@query("SET-3", sql=with_(EVENT_DIRS, body="SELECT DISTINCT day FROM event_dirs WHERE substr(md5(day), 1, 1) NOT IN ('0', '1', '2', '3')"))
def pending_days(spark: SparkSession, sf: str) -> DataFrame:
    days = views.event_dirs(spark, sf).select("day").distinct()
    digit = F.substring(F.md5("day"), 1, 1)
    status = F.when(digit == "0", "merged").when(digit == "1", "skipped").when(digit == "2", "failed").when(digit == "3", "done")
    units = days.select(F.lit("03a").alias("run"), F.col("day").alias("unit"))
    ledger = days.select(F.lit("03a").alias("run"), F.col("day").alias("unit"), status.alias("status")).where("status IS NOT NULL")
    none = units.where("false").select("run", F.lit("").alias("field"))
    return themes.pending_units(units, ledger, none).select(F.col("unit").alias("day"))


FIELDS = ["source_dir", "level", "home_city", "snapshot"]
CONTEXT = """stored AS (SELECT c_custkey AS run, unnest(['source_dir', 'level', 'home_city', 'snapshot']) AS field, unnest(['/in/' || c_nationkey, 'A', c_mktsegment, CASE WHEN c_custkey % 4 <> 0 THEN md5(c_name) END]) AS value FROM customer WHERE c_custkey % 11 <> 0),
current AS (SELECT c_custkey AS run, unnest(['source_dir', 'level', 'home_city', 'snapshot']) AS field, unnest(['/in/' || CASE WHEN c_custkey % 5 = 0 THEN 99 ELSE c_nationkey END, CASE WHEN c_custkey % 7 = 0 THEN 'C' ELSE 'A' END, c_mktsegment, CASE WHEN c_custkey % 4 <> 0 THEN md5(c_name) END]) AS value FROM customer),
differs AS (SELECT run, field, s.value AS old, c.value AS new FROM stored s FULL JOIN current c USING (run, field) WHERE s.value IS DISTINCT FROM c.value)"""


def contexts(spark: SparkSession, sf: str):
    """Stored and current run contexts, long form: one run per customer."""
    c = views.table(spark, sf, "customer")
    i = F.col("c_custkey")
    snap = F.when(i % 4 != 0, F.md5("c_name"))

    def long(values: list) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in zip(FIELDS, values)])
        return c.select(i.alias("run"), F.explode(pairs).alias("p")).select("run", "p.*")

    stored = long([F.concat(F.lit("/in/"), "c_nationkey"), F.lit("A"), F.col("c_mktsegment"), snap]).where("run % 11 != 0")
    moved = F.when(i % 5 == 0, F.lit(99)).otherwise(F.col("c_nationkey"))
    current = long([F.concat(F.lit("/in/"), moved), F.when(i % 7 == 0, "C").otherwise("A"), F.col("c_mktsegment"), snap])
    return stored, current


@query("SCL-27", sql=with_(CONTEXT, body="SELECT run, field, old, new FROM differs"))
def context_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return themes.context_mismatch(*contexts(spark, sf))


@query("OPS-12", sql=with_(CONTEXT, body="SELECT o_custkey AS run, o_orderkey AS unit FROM orders WHERE o_orderstatus <> 'F' OR o_custkey IN (SELECT run FROM differs)"))
def resumed_units(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("unit"), "o_orderstatus")
    ledger = o.where("o_orderstatus = 'F'").select("run", "unit", F.lit("done").alias("status"))
    return themes.pending_units(o.select("run", "unit"), ledger, themes.context_mismatch(*contexts(spark, sf)))


@query("AGG-15", "SORT-2", sql=with_(EVENT_FILES, body=r"SELECT split_part(path, '/', 3) AS folder, count(*) AS photos FROM event_files WHERE regexp_matches(lower(path), '\.(jpg|jpeg|png)$') AND split_part(path, '/', 3) <> '_FAILED_FOR_MANUAL_REVIEW' GROUP BY 1 ORDER BY photos DESC, folder LIMIT 20"))
def largest_events(spark: SparkSession, sf: str) -> DataFrame:
    return archived_counts(spark, sf).orderBy(F.desc("photos"), "folder").limit(20)


def archived_counts(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.operators.files import PICTURE_ENDING

    top = F.split_part("path", F.lit("/"), F.lit(3))
    f = views.event_files(spark, sf).where(F.col("path").rlike(PICTURE_ENDING))
    return f.groupBy(top.alias("folder")).agg(F.count("*").alias("photos")).where("folder != '_FAILED_FOR_MANUAL_REVIEW'")


@query("AGG-15", sql=with_(EVENT_FILES, body=r"SELECT split_part(path, '/', 3) AS folder, count(*) AS photos FROM event_files WHERE regexp_matches(lower(path), '\.(jpg|jpeg|png)$') AND split_part(path, '/', 3) <> '_FAILED_FOR_MANUAL_REVIEW' GROUP BY 1"))
def archived_per_event(spark: SparkSession, sf: str) -> DataFrame:
    return archived_counts(spark, sf)


@query("AGG-23", "SCL-21", sql=with_(ARCHIVE, body="SELECT year AS period, 'year' AS mode, count(*) AS photos FROM arch GROUP BY 1 UNION ALL SELECT year || '-' || month, 'month', count(*) FROM arch GROUP BY 1"))
def period_totals(spark: SparkSession, sf: str) -> DataFrame:
    a = archive_photos(spark, sf)

    def per(mode: str) -> DataFrame:
        return a.groupBy(themes.period_folder(F.col("day"), mode).alias("period")).agg(F.count("*").alias("photos")).withColumn("mode", F.lit(mode))

    return per("year").unionByName(per("month"))


@query("OPS-11", "WIN-6", sql=with_(ARCHIVE, body=r"""SELECT folder, name, src, CASE WHEN rn = 1 THEN name ELSE regexp_replace(name, '(\.[^.]*)$', '_' || mark || '_' || substr(md5(src), 1, 8) || '\1') END AS final_name, CASE WHEN rn = 1 THEN 'copied' ELSE 'copied_hashed' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY src) AS rn FROM (SELECT year || '-' || month AS folder, regexp_extract(path, '[^/]*$') AS name, path AS src, replace(day, '-', '') AS mark FROM arch))"""))
def period_reorganise(spark: SparkSession, sf: str) -> DataFrame:
    return themes.period_plan(archive_photos(spark, sf), "month")


@query("OPS-11", "WIN-6", "SNK-8", sql=with_(ARCHIVE, *copies_sql("(SELECT year || '-' || month AS folder, regexp_extract(path, '[^/]*$') AS name, path AS src, replace(day, '-', '') AS mark FROM arch)", mark="mark || '_'"),
  body="SELECT folder, name, src, final_name, status FROM copies"))
def period_to_target(spark: SparkSession, sf: str) -> DataFrame:
    """The period plan where the periods' folders hold files already."""
    photos = settle(archive_photos(spark, sf).withColumns(views.content_of(F.col("path"))))
    wanted = themes.period_plan(photos, "month").select("folder", "name", "src").withColumns(views.content_of(F.col("src")))
    marks = photos.select(F.col("path").alias("src"), F.replace("day", F.lit("-"), F.lit("")).alias("mark")).distinct()
    target = views.copy_target(wanted.join(marks, "src"), F.concat("mark", F.lit("_"))).drop("mark")
    return themes.period_plan(photos, "month", target=settle(target)).select("folder", "name", "src", "final_name", "status")
