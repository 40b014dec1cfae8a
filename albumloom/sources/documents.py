"""Nested documents: manifests of merged days and themes, the yearly index, the ungrouped list, the comparison report.

A document is a folder of JSON lines. What can be long, the photos of an event, comes in lines of at most ``PER_LINE``
names, and events are rows, so no task holds a whole day or theme whatever its size. Readers take the schemas here, so
fields that are null in all rows come back too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.operators import compare
from albumloom.operators.progress import chunked

PER_LINE = 1000
# fixed values: texts of the ungrouped list
UNGROUPED_NAME = "未归类事件"
UNGROUPED_NOTE = "未归类事件不复制照片，仅记录清单供人工查阅"

EVENT_LINE = "event_tag string, source_folder string, photo_count bigint, done_count bigint, part bigint, photos array<string>"
DAY_SCHEMA = f"date string, merged_name string, llm_reason string, {EVENT_LINE}"
THEME_SCHEMA = f"theme_folder string, theme string, year_range array<string>, {EVENT_LINE}"
THEME_ROW = "theme string, theme_folder string, event_count bigint, photo_count bigint, year_range array<string>"
UNGROUPED_ROW = "event_tag string, source_folder string, photo_count bigint"
INDEX_HEADER = "source_target_dir string, output_dir string, total_events_scanned bigint, total_events_grouped bigint, total_events_ungrouped bigint"
UNGROUPED_HEADER = "theme string, theme_folder string, description string, year_range array<string>, event_count bigint, total_photos bigint"


def event_lines(events: DataFrame, plan: DataFrame, keys: Sequence[str], per_line: int = PER_LINE) -> DataFrame:
    """Events (keys, tag, source_folder, photo_count, ...) with the photos that a plan (keys, tag, src, final_name) puts in place.

    One row per event and ``per_line`` photos, ``part`` counted from 0, photos in the order of their sources;
    ``done_count`` is that of the whole event. An event without photos has one row with an empty list.
    """
    keys = [*keys, "tag"]
    placed = chunked(plan.select(*keys, "src", "final_name"), keys, ["src", "final_name"], per_line)
    names = F.array_sort(F.collect_list(F.struct("number", "final_name")))
    lines = placed.groupBy(*keys, "chunk").agg(names.alias("got")).select(*keys, F.col("chunk").alias("part"), F.transform("got", lambda g: g["final_name"]).alias("photos"))
    done = plan.groupBy(*keys).agg(F.count("*").alias("done_count"))
    out = events.join(done, keys, "left").join(lines, keys, "left")
    return out.withColumns({
        "done_count": F.coalesce("done_count", F.lit(0).cast("bigint")), "part": F.coalesce("part", F.lit(0).cast("bigint")),
        "photos": F.coalesce("photos", F.array().cast("array<string>")),
    }).withColumnRenamed("tag", "event_tag")


def day_documents(days: DataFrame, plan: DataFrame, events: DataFrame, root: str, per_line: int = PER_LINE) -> DataFrame:
    """Lines of the manifests of merged days, as ``DAY_SCHEMA``. Events: day, tag, photo_count; their folders lie in ``root``."""
    merged = days.where("state = 'merged'").select("day", F.col("folder").alias("merged_name"), F.col("reason").alias("llm_reason"))
    known = events.select("day", "tag", F.concat(F.lit(root + "/"), "tag").alias("source_folder"), "photo_count").join(merged, "day")
    return as_schema(event_lines(known, plan, ["day"], per_line).withColumnRenamed("day", "date"), DAY_SCHEMA)


def theme_documents(members: DataFrame, valid: DataFrame, events: DataFrame, plan: DataFrame, root: str, per_line: int = PER_LINE) -> DataFrame:
    """Lines of the manifests of valid themes, as ``THEME_SCHEMA``. Events: tag, photo_count; plan: theme, tag, src, final_name."""
    listed = members.join(valid.select("theme", "theme_folder", F.col("years").alias("year_range")), "theme")
    known = listed.join(events.select("tag", F.concat(F.lit(root + "/"), "tag").alias("source_folder"), "photo_count"), "tag")
    return as_schema(event_lines(known, plan, ["theme"], per_line), THEME_SCHEMA)


def yearly_index(valid: DataFrame, rest: DataFrame, events: DataFrame, source: str, out: str) -> dict[str, DataFrame]:
    """The index over all themes: ``header`` (one row), ``themes`` and ``ungrouped`` (the events in none)."""
    listed = valid.select("theme", "theme_folder", F.col("events").alias("event_count"), F.col("photos").alias("photo_count"), F.col("years").alias("year_range"))
    header = events.agg(F.count("*").alias("total_events_scanned")).select(
        F.lit(source).alias("source_target_dir"), F.lit(out).alias("output_dir"), "total_events_scanned",
        listed.agg(F.coalesce(F.sum("event_count"), F.lit(0))).scalar().alias("total_events_grouped"), rest.agg(F.count("*")).scalar().alias("total_events_ungrouped"),
    )
    return {"header": as_schema(header, INDEX_HEADER), "themes": as_schema(listed, THEME_ROW), "ungrouped": rest.select(F.col("tag").alias("event_tag"))}


def ungrouped_list(rest: DataFrame, root: str) -> dict[str, DataFrame]:
    """The list of events in no theme: ``header`` (one row, none where every event has a theme) and ``events``."""
    per_year = rest.groupBy("year").agg(F.count("*").alias("n"), F.sum("photo_count").alias("p"))
    header = per_year.agg(F.sum("n").alias("event_count"), F.sum("p").alias("total_photos"), F.array_sort(F.collect_list("year")).alias("year_range")).where("event_count > 0")
    header = header.withColumns({"theme": F.lit(UNGROUPED_NAME), "theme_folder": F.lit(None).cast("string"), "description": F.lit(UNGROUPED_NOTE)})
    listed = rest.select(F.col("tag").alias("event_tag"), F.concat(F.lit(root + "/"), "tag").alias("source_folder"), "photo_count")
    return {"header": as_schema(header, UNGROUPED_HEADER), "events": as_schema(listed, UNGROUPED_ROW)}


def as_schema(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema text, in its order and types."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])


def write_manifests(rows: DataFrame, by: str, out: str) -> None:
    """JSON lines in one folder per value of ``by``; a large one is spread over several files.

    ``by`` is not null and not empty: it is a day or a folder name.
    """
    rows.repartitionByRange(by, "event_tag", "part").sortWithinPartitions(by, "event_tag", "part").write.mode("overwrite").partitionBy(by).json(out)


def read_manifests(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All lines of the manifests below a folder."""
    return as_schema(spark.read.schema(schema).json(out), schema)


def write_document(parts: dict[str, DataFrame], out: str) -> None:
    """Each part of a document as JSON lines in a folder of its own."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{out}/{name}")


def read_document(spark: SparkSession, out: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The parts that ``schemas`` names."""
    return {name: spark.read.schema(schema).json(f"{out}/{name}") for name, schema in schemas.items()}


# fixed values: sheets and headings of the comparison report
SHEETS = ["统计汇总", "差异统计", "差异照片", "完整对比", "关键词分析"]
NO_REASON = "未在日志中找到"


def compared_in_full(decisions: DataFrame, runs: list[str]) -> DataFrame:
    """One row per photo: the consensus and, per run, decision, reason and event; what a run has not judged is MISSING.

    Decisions: run_key, photo_id, decision, reason, event_tag, one row per run and photo. There are as many columns as runs are compared.
    """
    told = decisions.select("photo_id", "run_key", F.struct("decision", "reason", "event_tag").alias("d"))
    wide = told.groupBy("photo_id").pivot("run_key", runs).agg(F.first("d"))
    absent = {"decision": "MISSING", "reason": NO_REASON, "event": ""}
    columns = [
        F.coalesce(_of(run)["event_tag" if kind == "event" else kind], F.lit(text)).alias(f"{run}_{kind}") for run in runs for kind, text in absent.items()
    ]
    seen = F.array_distinct(F.array_compact(F.array(*[_of(run)["decision"] for run in runs])))
    consensus = F.when(F.size(seen) == 1, "一致").when(F.size(seen) == 0, "全MISSING").otherwise("不一致")
    return wide.select("photo_id", consensus.alias("consensus"), *columns)


def _of(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def report_sheets(decisions: DataFrame, runs: DataFrame, wide: DataFrame, names: list[str], words: DataFrame) -> dict[str, DataFrame]:
    """The five sheets of a comparison.

    Runs: run_key, provider, model, extraction_level, token_total. ``wide`` is ``compared_in_full`` of the run keys ``names``, stored;
    words: (model, decision, word, n) where model is the run key.
    """
    unknown = {c: F.coalesce(c, F.lit("Unknown")) for c in ("model", "provider", "extraction_level")}
    counted = compare.run_stats(decisions.select(F.col("run_key").alias("model"), "decision")).withColumnRenamed("model", "run_key")
    stats = runs.select("run_key", *[v.alias(k) for k, v in unknown.items()], F.coalesce("token_total", F.lit(0)).alias("token_total")).join(counted, "run_key", "left")
    none = F.lit(0).cast("bigint")
    stats = stats.select(
        F.col("run_key").alias("运行"), F.col("model").alias("模型"), F.col("provider").alias("Provider"), F.col("extraction_level").alias("档位"),
        *[F.coalesce(c, none).alias(name) for c, name in (("total", "输入总数"), ("kept", "保留"), ("deleted", "删除"))],
        F.coalesce("keep_pct", F.lit(0.0)).alias("保留率%"), F.col("token_total").alias("Token消耗"),
    )
    classes = compare.consensus_counts(wide).select(F.col("consensus").alias("类别"), F.col("n").alias("数量"), F.col("pct").alias("占比%"))
    differ = wide.where("consensus = '不一致'")
    # only photos that every other run has judged and deleted count as kept by one alone
    alone = F.array(*[
        F.when((_of(f"{k}_decision") == "keep") & F.forall(F.array(*[_of(f"{o}_decision") for o in names if o != k]).cast("array<string>"), lambda d: d == "delete"), F.lit(f"仅{k}保留"))
        for k in names
    ])
    total = wide.agg(F.count("*")).scalar()
    keepers = differ.select(F.explode(F.array_compact(alone)).alias("类别")).groupBy("类别").agg(F.count("*").alias("数量"))
    keepers = keepers.withColumn("占比%", F.round(F.col("数量") * 100.0 / total, 1))
    return dict(zip(SHEETS, [stats, classes.unionByName(keepers), differ.orderBy("photo_id"), wide.orderBy("photo_id"), keyword_sheet(runs, words)]))


def keyword_sheet(runs: DataFrame, words: DataFrame, shown: int = 5) -> DataFrame:
    """Per run the most frequent words of kept and of deleted photos, ``word(n)``, and how many words there are in all; ties by word."""
    top = compare.keywords(words, shown)
    text = F.concat("word", F.lit("("), F.col("n").cast("string"), F.lit(")"))
    listed = top.groupBy(F.col("model").alias("run_key"), "decision").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("w"), F.first("all_words").alias("n"))
    listed = listed.withColumn("w", F.array_join(F.transform("w", lambda x: x["t"]), ", "))

    def one(decision: str, column: str) -> Column:
        return F.max(F.when(F.col("decision") == decision, F.col(column)))

    kinds = (("keep", "保留"), ("delete", "删除"))
    per = listed.groupBy("run_key").agg(*[one(d, c).alias(f"{d}_{c}") for d, _ in kinds for c in "wn"])
    rows = runs.select("run_key").join(per, "run_key", "left")
    return rows.select(
        F.col("run_key").alias("模型"), *[F.coalesce(f"{d}_w", F.lit("")).alias(f"{name}理由高频词TOP5") for d, name in kinds],
        *[F.coalesce(f"{d}_n", F.lit(0).cast("bigint")).alias(f"{name}理由总词数") for d, name in kinds],
    )


CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_report(sheets: dict[str, DataFrame], out: str) -> None:
    """Each sheet as CSV with a header, texts as they are."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").options(**CSV).csv(f"{out}/{name}")


def read_report(spark: SparkSession, out: str, names: Sequence[str] = tuple(SHEETS)) -> dict[str, DataFrame]:
    """Sheets as text columns; an empty cell is an empty text, as sheets know no null.

    The files of a sheet are read whole, so that texts may hold line breaks; each task wrote one of its own.
    """
    return {name: spark.read.options(**CSV, multiLine=True).csv(f"{out}/{name}").na.fill("") for name in names}
