"""Documents written and read back: day and theme manifests, yearly index, ungrouped list, comparison report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.operators import compare, themes
from albumloom.plans import albums, views
from albumloom.plans.oracle import EVENT_FILES, RUN_LOGS, with_
from albumloom.plans.registry import query
from albumloom.session import settle
from albumloom.sources import documents, folders
from albumloom.streaming.runtime import scratch

# few enough that the larger events take several lines
LINE = 2
LINES = "(row_number() OVER (PARTITION BY {} ORDER BY src) - 1) // 2 AS part"


def joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


@query("SNK-3", sql=with_(*albums.DAYS, f"named AS (SELECT day, tag, src, CASE WHEN rn = 1 THEN name ELSE regexp_replace(name, '(\\.[^.]*)$', '_' || substr(md5(src), 1, 8) || '\\1') END AS final_name, {LINES.format('day, tag')} FROM plan)",
  "told AS (SELECT day, tag, part, string_agg(final_name, '|' ORDER BY src) AS photos, (sum(count(*)) OVER (PARTITION BY day, tag))::BIGINT AS done_count FROM named GROUP BY day, tag, part)",
  body="""SELECT h.day AS date, d.folder AS merged_name, d.reason AS llm_reason, h.tag AS event_tag, '/archive/' || h.tag AS source_folder, h.photo_count, coalesce(done_count, 0) AS done_count, coalesce(part, 0) AS part, coalesce(photos, '') AS photos
  FROM have h JOIN days d USING (day) LEFT JOIN told t ON t.day = h.day AND t.tag = h.tag WHERE d.state = 'merged'"""))
def day_manifest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of the merged days with the photos of each event, as read back."""
    days, plan, events = albums.merged_days(spark, sf)
    out = scratch(spark, "days")
    documents.write_manifests(documents.day_documents(days, settle(plan), events, "/archive", LINE), "date", out)
    return documents.read_manifests(spark, out, documents.DAY_SCHEMA).withColumn("photos", joined("photos"))


PICTURES = r"pics AS (SELECT split_part(path, '/', 3) AS tag, path AS src FROM event_files WHERE regexp_matches(lower(path), '\.(jpg|jpeg|png)$'))"


@query("SNK-4", sql=with_(*albums.CLUSTER, EVENT_FILES, PICTURES,
  r"""wanted AS (SELECT theme, tag, src, regexp_extract(src, '[^/]*$') AS name FROM merged JOIN valid USING (theme) JOIN pics USING (tag)),
named AS (SELECT *, row_number() OVER (PARTITION BY theme, tag, name ORDER BY src) AS rn, """ + LINES.format("theme, tag") + r""" FROM wanted),
told AS (SELECT theme, tag, part, string_agg(CASE WHEN rn = 1 THEN name ELSE regexp_replace(name, '(\.[^.]*)$', '_' || substr(md5(src), 1, 8) || '\1') END, '|' ORDER BY src) AS photos, (sum(count(*)) OVER (PARTITION BY theme, tag))::BIGINT AS done_count FROM named GROUP BY theme, tag, part)""",
  body="""SELECT theme_folder, theme, replace(years, ',', '|') AS year_range, m.tag AS event_tag, '/archive/' || m.tag AS source_folder, m.photo_count, coalesce(done_count, 0) AS done_count, coalesce(part, 0) AS part, coalesce(t.photos, '') AS photos
  FROM merged m JOIN valid USING (theme) LEFT JOIN told t USING (theme, tag)"""))
def theme_manifest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of the valid themes with the photos copied of each event, as read back."""
    members, valid, _ = albums.clustered(spark, sf)
    plan = settle(themes.theme_copies(members, valid, folders.event_photos(views.event_files(spark, sf), "/archive")))
    out = scratch(spark, "themes")
    documents.write_manifests(documents.theme_documents(members, valid, views.events_by_tag(spark, sf), plan, "/archive", LINE), "theme_folder", out)
    read = documents.read_manifests(spark, out, documents.THEME_SCHEMA)
    return read.withColumns({"photos": joined("photos"), "year_range": joined("year_range")})


FREE = "free AS (SELECT * FROM merged WHERE theme NOT IN (SELECT theme FROM valid))"


@query("SNK-4", sql=with_(*albums.CLUSTER, FREE, body="""SELECT 'header' AS part, NULL::VARCHAR AS theme, NULL::VARCHAR AS theme_folder, NULL::BIGINT AS event_count, NULL::BIGINT AS photo_count, NULL::VARCHAR AS year_range, NULL::VARCHAR AS event_tag, '/archive' AS source_target_dir, '/out' AS output_dir,
    (SELECT count(*) FROM events_by_tag) AS total_events_scanned, (SELECT coalesce(sum(events), 0)::BIGINT FROM valid) AS total_events_grouped, (SELECT count(*) FROM free) AS total_events_ungrouped
  UNION ALL SELECT 'themes', theme, theme_folder, events, photos, replace(years, ',', '|'), NULL, NULL, NULL, NULL, NULL, NULL FROM valid
  UNION ALL SELECT 'ungrouped', NULL, NULL, NULL, NULL, NULL, tag, NULL, NULL, NULL, NULL, NULL FROM free"""))
def yearly_index_document(spark: SparkSession, sf: str) -> DataFrame:
    """The index over all themes: totals, themes and the events in none, as read back."""
    _, valid, rest = albums.clustered(spark, sf)
    out = scratch(spark, "index")
    documents.write_document(documents.yearly_index(settle(valid), settle(rest), views.events_by_tag(spark, sf), "/archive", "/out"), out)
    parts = documents.read_document(spark, out, {"header": documents.INDEX_HEADER, "themes": documents.THEME_ROW, "ungrouped": "event_tag string"})
    rows = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True).withColumn("year_range", joined("year_range"))


@query("SNK-5", "SET-2", sql=with_(*albums.CLUSTER, FREE, body="""SELECT 'header' AS part, '未归类事件' AS theme, NULL::VARCHAR AS theme_folder, '未归类事件不复制照片，仅记录清单供人工查阅' AS description, string_agg(DISTINCT year, '|' ORDER BY year) AS year_range, count(*) AS event_count, sum(photo_count)::BIGINT AS total_photos,
    NULL::VARCHAR AS event_tag, NULL::VARCHAR AS source_folder, NULL::BIGINT AS photo_count FROM free HAVING count(*) > 0
  UNION ALL SELECT 'events', NULL, NULL, NULL, NULL, NULL, NULL, tag, '/archive/' || tag, photo_count FROM free"""))
def ungrouped_list_document(spark: SparkSession, sf: str) -> DataFrame:
    """The list of events in no theme, as read back."""
    rest = settle(albums.clustered(spark, sf)[2])
    out = scratch(spark, "ungrouped")
    documents.write_document(documents.ungrouped_list(rest, "/archive"), out)
    parts = documents.read_document(spark, out, {"header": documents.UNGROUPED_HEADER, "events": documents.UNGROUPED_ROW})
    both = parts["header"].withColumn("part", F.lit("header")).unionByName(parts["events"].withColumn("part", F.lit("events")), allowMissingColumns=True)
    return both.withColumn("year_range", joined("year_range"))


RUN = "CASE model WHEN 'A' THEN 'ollama-vision-A-with-a-very' WHEN 'B' THEN 'ollama-vision-A-with-a-very#2' WHEN 'C' THEN 'openai-vision-C-with-a-very' ELSE 'ollama-vision-D-with-a-very' END"
REPORT = [
    RUN_LOGS,
    f"""judged AS (SELECT photo_id, model, {RUN} AS run, decision, reason, CASE WHEN decision = 'keep' THEN day || '-x' ELSE '' END AS event FROM decisions)""",
    """runs AS (SELECT DISTINCT model, run FROM judged)""",
    """grid AS (SELECT p.photo_id, r.run, coalesce(j.decision, 'MISSING') AS decision, coalesce(j.reason, '未在日志中找到') AS reason, coalesce(j.event, '') AS event
  FROM (SELECT DISTINCT photo_id FROM judged) p CROSS JOIN runs r LEFT JOIN judged j ON j.photo_id = p.photo_id AND j.run = r.run)""",
    """photos_judged AS (SELECT photo_id, CASE WHEN count(DISTINCT decision) FILTER (decision <> 'MISSING') = 1 THEN '一致' ELSE '不一致' END AS consensus, max(run) FILTER (decision = 'keep') AS keeper,
  count(*) FILTER (decision = 'keep') = 1 AND count(*) FILTER (decision = 'delete') = (SELECT count(*) FROM runs) - 1 AS alone FROM grid GROUP BY photo_id)""",
    """cells AS (SELECT photo_id AS item, run || '_decision' AS field, decision AS value FROM grid UNION ALL SELECT photo_id, run || '_reason', reason FROM grid UNION ALL SELECT photo_id, run || '_event', event FROM grid
  UNION ALL SELECT photo_id, 'consensus', consensus FROM photos_judged)""",
    """classes AS (SELECT consensus AS item, count(*) AS n FROM photos_judged GROUP BY 1 UNION ALL SELECT '仅' || keeper || '保留', count(*) FROM photos_judged WHERE alone GROUP BY 1)""",
    f"""stats AS (SELECT {RUN} AS item, 'org/vision-' || CASE WHEN model = 'B' THEN 'A' ELSE model END || '-with-a-very-long-name' AS m, CASE WHEN model = 'C' THEN 'openai' ELSE 'ollama' END AS p, CASE WHEN model = 'C' THEN 'C' ELSE 'A' END AS l,
  n, n - gone AS kept, gone, round((n - gone) * 100.0::DOUBLE / n, 1) AS pct, n * 1234 AS tokens FROM meta)""",
    r"""words AS (SELECT run, decision, word, count(*) AS n FROM (SELECT run, decision, unnest(regexp_extract_all(reason, '[\x{4e00}-\x{9fff}]{2,}')) AS word FROM judged) GROUP BY ALL)""",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY run, decision ORDER BY n DESC, word) AS rank FROM words)""",
    """lists AS (SELECT run, decision, string_agg(word || '(' || n || ')', ', ' ORDER BY rank) FILTER (rank <= 5) AS top, sum(n)::BIGINT AS n FROM ranked GROUP BY ALL)""",
]
KINDS = "(VALUES ('keep', '保留'), ('delete', '删除')) k(decision, name)"


@query("OPS-14", "SNK-7", sql=with_(*REPORT, body=f"""SELECT '完整对比' AS sheet, item, field, value FROM cells UNION ALL SELECT '差异照片', c.item, field, value FROM cells c JOIN photos_judged p ON p.photo_id = c.item WHERE consensus = '不一致'
  UNION ALL SELECT '差异统计', item, '数量', n::VARCHAR FROM classes UNION ALL SELECT '差异统计', item, '占比%', round(n * 100.0::DOUBLE / (SELECT count(*) FROM photos_judged), 1)::VARCHAR FROM classes
  UNION ALL SELECT '统计汇总', item, unnest(['模型', 'Provider', '档位', '输入总数', '保留', '删除', '保留率%', 'Token消耗']), unnest([m, p, l, n::VARCHAR, kept::VARCHAR, gone::VARCHAR, pct::VARCHAR, tokens::VARCHAR]) FROM stats
  UNION ALL SELECT '关键词分析', r.run, k.name || '理由高频词TOP5', coalesce(top, '') FROM runs r CROSS JOIN {KINDS} LEFT JOIN lists l ON l.run = r.run AND l.decision = k.decision
  UNION ALL SELECT '关键词分析', r.run, k.name || '理由总词数', coalesce(n, 0)::VARCHAR FROM runs r CROSS JOIN {KINDS} LEFT JOIN lists l ON l.run = r.run AND l.decision = k.decision"""))
def comparison_report(spark: SparkSession, sf: str) -> DataFrame:
    """The five sheets of a comparison, cell by cell as read back."""
    lines = views.run_logs(spark, sf)
    runs = settle(compare.run_keys(compare.log_metadata(lines)))
    names = [r["run_key"] for r in runs.select("run_key", "file").orderBy("file").collect()]  # one per compared run: the columns of a sheet
    told = settle(compare.log_decisions(lines).join(runs.select("file", "run_key"), "file"))
    wide = settle(documents.compared_in_full(told, names))
    words = compare.word_counts(told.select(F.col("run_key").alias("model"), "decision", "reason"), compare.chinese_tokens(F.col("reason")))
    out = scratch(spark, "report")
    documents.write_report(documents.report_sheets(told, runs, wide, names, settle(words)), out)
    cells = None
    for sheet, rows in documents.read_report(spark, out).items():
        first = rows.columns[0]
        long = rows.unpivot([first], rows.columns[1:], "field", "value").select(F.lit(sheet).alias("sheet"), F.col(first).alias("item"), "field", "value")
        cells = long if cells is None else cells.unionByName(long)
    return cells
