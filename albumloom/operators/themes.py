"""Days and themes: which days to merge, first and second grouping pass, filters, folders, plans, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumloom.functions.names import basename, clean_tag
from albumloom.functions.replies import merge_decision, merge_map, theme_items
from albumloom.operators.curation import Scorer, requests, retry_truncated
from albumloom.operators.naming import CONTENT, plan_copies
from albumloom.operators.ordering import in_order
from albumloom.operators.progress import chunked
from albumloom.params import Themes
from albumloom.session import settle


def day_classes(events: DataFrame, p: Themes = Themes()) -> DataFrame:
    """Per day: multi (to be judged), merged (a merge result) or single."""
    per = events.groupBy("day").agg(F.count("*").alias("events"), F.sum("photo_count").alias("photos"), F.bool_or("has_manifest").alias("manifest"))
    kind = F.when(F.col("events") > p.day_merge_threshold, "multi").when(F.col("manifest"), "merged").otherwise("single")
    return per.select("day", "events", "photos", kind.alias("class"))


def day_brief(events: DataFrame, shown: int = 5) -> DataFrame:
    """One line per day: event and photo counts, the first names and how many there are in all."""
    order = Window.partitionBy("day").orderBy("tag")
    first = events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    names = first.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("rank", "event_name"))).alias("f"))
    per = events.groupBy("day").agg(F.count("*").alias("n"), F.sum("photo_count").alias("photos")).join(names, "day")
    text = F.array_join(F.transform("f", lambda x: x["event_name"]), ", ")
    more = F.when(F.col("n") > shown, F.concat(F.lit(" 等 "), F.col("n").cast("string"), F.lit(" 个"))).otherwise("")
    return per.select("day", F.concat(F.col("n").cast("string"), F.lit(" 个事件 / "), F.col("photos").cast("string"), F.lit(" 张照片 ["), text, more, F.lit("]")).alias("brief"))


def fingerprint(events: DataFrame) -> DataFrame:
    """One row that changes when an event is added, removed, renamed or resized."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", "tag", F.col("photo_count").cast("string"))), 1, 15), 16, 10).cast("bigint")
    return events.agg(F.count("*").alias("events"), F.coalesce(F.bit_xor(part), F.lit(0)).alias("mix"), F.coalesce(F.sum(part % 1000000007), F.lit(0)).alias("mark"))


def decode_members(items: DataFrame, numbered: DataFrame) -> DataFrame:
    """(chunk, theme, number | tag) -> (theme, tag): numbers become tags, unknown numbers and tags fall out."""
    by_number = items.where("number IS NOT NULL").select("chunk", "theme", F.col("number").cast("bigint").alias("number"))
    from_number = by_number.join(numbered.select("chunk", "number", "tag"), ["chunk", "number"]).select("theme", "tag")
    return from_number.unionByName(items.where("tag IS NOT NULL").select("theme", "tag").join(numbered.select("tag"), "tag", "left_semi").select("theme", "tag"))


def united(members: DataFrame) -> DataFrame:
    """Distinct (theme, tag) with the size of the theme."""
    pairs = members.select("theme", "tag").distinct()
    return pairs.join(pairs.groupBy("theme").agg(F.count("*").alias("theme_size")), "theme")


def renamed(members: DataFrame, names: DataFrame) -> DataFrame:
    """Members under their merged theme names; unmapped themes keep theirs."""
    return members.join(names, "theme", "left").select(F.coalesce("merged", "theme").alias("theme"), "tag").distinct()


def theme_summary(members: DataFrame, events: DataFrame) -> DataFrame:
    """Per theme: events, photos, distinct years. Years are counted before they are listed."""
    rows = members.join(events.select("tag", "year", "photo_count"), "tag")
    per_year = rows.groupBy("theme", "year").agg(F.count("*").alias("n"), F.sum("photo_count").alias("p"))
    return per_year.groupBy("theme").agg(F.sum("n").alias("events"), F.sum("p").alias("photos"), F.array_sort(F.collect_list("year")).alias("years"))


def theme_folder(theme: Column, years: Column) -> Column:
    """First and last year in front of the theme, once when equal."""
    a, b = F.element_at(years, 1), F.element_at(years, -1)
    return clean_tag(F.concat(F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b)), F.lit("-"), theme))


def eligible(summary: DataFrame, p: Themes = Themes()) -> DataFrame:
    """Themes with enough events over enough different years, with their folder."""
    ok = summary.where((F.col("events") >= p.min_events) & (F.size("years") - 1 >= p.min_year_span))
    return ok.withColumn("theme_folder", theme_folder(F.col("theme"), F.col("years")))


def ungrouped(events: DataFrame, members: DataFrame, valid: DataFrame) -> DataFrame:
    """Events in no valid theme."""
    return events.join(members.join(valid.select("theme"), "theme", "left_semi").select("tag").distinct(), "tag", "left_anti")


def grouped_events(events: DataFrame, scorer: Scorer, p: Themes = Themes()) -> DataFrame:
    """First pass: numbered event lists to the scorer, (theme, tag) from its answers. An event may be in several themes."""
    numbered = chunked(events, [], ["tag"], p.batch_size)
    line = F.concat(F.col("number").cast("string"), F.lit(". "), "tag", F.lit("（"), F.col("photo_count").cast("string"), F.lit(" 张）"))
    asked = requests(numbered.select("chunk", F.col("number").alias("rank"), F.col("tag").alias("item_id"), line.alias("text")), ["chunk"], F.col("text"))
    replies = retry_truncated(asked.select(F.col("chunk").cast("string").alias("key"), "ids", "lines"), scorer)
    items = theme_items(replies.where("reply IS NOT NULL").select(F.col("key").cast("bigint").alias("chunk"), "reply"), ["chunk"])
    return decode_members(items, numbered).distinct()


def theme_requests(members: DataFrame, p: Themes = Themes()) -> DataFrame:
    """(chunk, ids, lines): numbered lists of themes with their event counts, largest first, for the second pass."""
    sizes = members.groupBy("theme").agg(F.count("*").alias("n")).withColumn("less", -F.col("n"))
    numbered = chunked(sizes, [], ["less", "theme"], p.theme_batch)
    # fixed values: the wording around names and counts
    line = F.concat(F.col("number").cast("string"), F.lit(". "), "theme", F.lit("（"), F.col("n").cast("string"), F.lit(" 个事件）"))
    asked = requests(numbered.select("chunk", F.col("number").alias("rank"), F.col("theme").alias("item_id"), line.alias("text")), ["chunk"], F.col("text"))
    n = F.size("ids").cast("string")
    whole = F.concat(F.lit("【主题列表】（共 "), n, F.lit(" 个主题）：\n"), "lines", F.lit("\n\n请把语义相同的主题合并，输出 JSON。"))
    return asked.select("chunk", "ids", whole.alias("lines"))


def final_names(names: DataFrame) -> DataFrame:
    """(theme, merged) -> the name at the end of each chain of renames, by doubling; of a ring, its smallest name."""
    links = settle(names.where("theme != merged").select("theme", "merged").distinct())
    # names that lead back to themselves: each step of doubling keeps the smallest name seen on the way
    links = links.withColumn("low", F.least("theme", "merged"))
    rounds = max(1, links.count().bit_length())
    for _ in range(rounds):
        on = links.select(F.col("theme").alias("merged"), F.col("merged").alias("next"), F.col("low").alias("next_low"))
        further = settle(links.join(on, "merged", "left"))
        links = further.select("theme", F.coalesce("next", "merged").alias("merged"), F.least("low", F.coalesce("next_low", "low")).alias("low"))
        if further.where("next IS NOT NULL").isEmpty():
            return links.select("theme", "merged")
    ring = links.select(F.col("theme").alias("merged"), F.lit(True).alias("round"))
    return links.join(ring, "merged", "left").select("theme", F.when(F.col("round"), F.col("low")).otherwise(F.col("merged")).alias("merged"))


def merged_themes(members: DataFrame, scorer: Scorer, p: Themes = Themes()) -> DataFrame:
    """Second pass: theme lists to the scorer, members under the names it gives to themes that mean the same.

    All themes are one list while they are ``theme_batch`` at most; more are asked in lists of that size, and what is left
    after renaming is asked again until it is one list or nothing changes. A list that is cut off is asked once more; one without a usable answer
    keeps its names. Fewer than two themes are not asked about.
    """
    while True:
        members = settle(members)
        lists = settle(theme_requests(members, p))
        asked = lists.where(F.size("ids") > 1)
        replies = settle(retry_truncated(asked.select(F.col("chunk").cast("string").alias("key"), "ids", "lines"), scorer))
        names = final_names(merge_map(replies.where("reply IS NOT NULL").select(F.col("key").cast("bigint").alias("at"), "reply"), members))
        if names.isEmpty():
            return members
        members = renamed(members, names)
        if lists.limit(2).count() < 2:
            return members


def cluster_themes(events: DataFrame, scorer: Scorer, merge_replies: DataFrame | None = None, p: Themes = Themes(), merge_scorer: Scorer | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both grouping passes: (members, valid themes, ungrouped events).

    The second pass asks ``merge_scorer``, or takes answers that are there already: ``merge_replies`` are (at, reply).
    """
    events = settle(events)
    first = grouped_events(events, scorer, p)
    if merge_scorer is not None:
        members = merged_themes(first, merge_scorer, p)
    else:
        members = first if merge_replies is None else renamed(first, merge_map(merge_replies, first))
    members = settle(members)
    valid = eligible(theme_summary(members, events), p)
    return members, valid, ungrouped(events, members, valid)


def theme_copies(members: DataFrame, valid: DataFrame, photos: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Copy plan of the valid themes: (folder, theme, tag, src, ...). Each event has its own folder in that of the theme.

    Photos (tag, path) of an event in several themes are copied into each.
    """
    content = CONTENT if target is not None else ()
    wanted = members.join(valid.select("theme", "theme_folder"), "theme").join(photos.select("tag", "path", *content), "tag")
    return plan_copies(wanted.select(F.concat_ws("/", "theme_folder", "tag").alias("folder"), basename(F.col("path")).alias("name"), F.col("path").alias("src"), "theme", "tag", *content), target=target)


def free_version(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(day, name) -> ``folder``: the name, or name_v2, name_v3 ... past the folders that exist.

    Versions of a name are put in order; the first one that is not its place says where the gap is.
    """
    taken = existing.select(
        F.regexp_replace("tag", r"_v\d+$", "").alias("name"), F.coalesce(F.regexp_extract("tag", r"_v(\d+)$", 1).try_cast("bigint"), F.lit(1)).alias("v")
    ).unionByName(existing.select(F.col("tag").alias("name"), F.lit(1).cast("bigint").alias("v")))
    used = wanted.select("name").distinct().join(taken, "name").where("v >= 1").distinct()
    placed = in_order(used, ["name"], ["v"]).withColumn("place", F.col("pos") + 1)
    # without a version 1 every later place is off and the name itself is free
    gap = F.coalesce(F.min(F.when(F.col("v") != F.col("place"), F.col("place"))), F.max("place") + 1)
    first = placed.groupBy("name").agg(gap.alias("free"))
    return wanted.join(first, "name", "left").withColumn(
        "folder", F.when(F.coalesce("free", F.lit(1)) > 1, F.concat("name", F.lit("_v"), F.col("free").cast("string"))).otherwise(F.col("name"))
    ).drop("free")


def merge_days(events: DataFrame, photos: DataFrame, scorer: Scorer, p: Themes = Themes(), target: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(days, plan): each multi-event day with its state and folder, and the move plan of the merged days.

    Events: day, tag, event_name, photo_count, has_manifest. Photos: day, tag, path, and size and md5 where there is a listing of the target.
    """
    events = settle(events)
    multi = day_classes(events, p).where("class = 'multi'").select("day")
    listed = events.join(multi, "day", "left_semi")
    line = F.concat("event_name", F.lit("（"), F.col("photo_count").cast("string"), F.lit(" 张）"))
    asked = requests(listed.select("day", F.col("tag").alias("rank"), F.col("tag").alias("item_id"), line.alias("text")), ["day"], F.col("text"))
    answers = retry_truncated(asked.select(F.col("day").alias("key"), "ids", "lines"), scorer)
    d = merge_decision(answers, ["key"]).select(F.col("key").alias("day"), "decision.*")
    first = listed.groupBy("day").agg(F.min_by("event_name", "tag").alias("first_name"))
    state = F.when(F.col("should_merge").isNull(), "failed").when(F.col("should_merge"), "merged").otherwise("skipped")
    name = clean_tag(F.concat("day", F.lit("-"), F.when(F.col("merged_name") != "", F.col("merged_name")).otherwise(F.col("first_name"))))
    days = settle(free_version(d.join(first, "day").select("day", state.alias("state"), "reason", name.alias("name")), events).select(
        "day", "state", "reason", F.when(F.col("state") == "merged", F.col("folder")).alias("folder")
    ))
    moving = photos.join(days.where("state = 'merged'").select("day", "folder"), "day")
    content = CONTENT if target is not None else ()
    return days, plan_copies(moving.select("folder", basename(F.col("path")).alias("name"), F.col("path").alias("src"), "day", "tag", *content), target=target)


def day_manifest(days: DataFrame, plan: DataFrame, events: DataFrame) -> DataFrame:
    """Per merged day and original event: photos counted and moved."""
    moved = plan.groupBy("day", "tag").agg(F.count("*").alias("moved_count"))
    merged = days.where("state = 'merged'").select("day", F.col("folder").alias("merged_name"), "reason")
    return events.select("day", "tag", "photo_count").join(merged, "day").join(moved, ["day", "tag"], "left").withColumn("moved_count", F.coalesce("moved_count", F.lit(0)))


def context_mismatch(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(run, field, old, new) for every field that differs between the stored and the current context."""
    s = stored.select("run", "field", F.col("value").alias("old"))
    c = current.select("run", "field", F.col("value").alias("new"))
    return s.join(c, ["run", "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")))


def pending_units(units: DataFrame, ledger: DataFrame, mismatch: DataFrame) -> DataFrame:
    """(run, unit) still to do: not in the ledger, or all of a run whose context changed."""
    void = mismatch.select("run").distinct()
    done = ledger.where(F.col("status").isin("merged", "skipped", "failed", "done")).join(void, "run", "left_anti")
    return units.join(done.select("run", "unit"), ["run", "unit"], "left_anti")


def period_plan(photos: DataFrame, mode: str, target: DataFrame | None = None) -> DataFrame:
    """Copy plan by year or month: names taken already get the day and a digest. With a listing of the target, photos bring size and md5."""
    folder = period_folder(F.col("day"), mode)
    rows = photos.select(folder.alias("folder"), basename(F.col("path")).alias("name"), F.col("path").alias("src"), F.replace("day", F.lit("-"), F.lit("")).alias("mark"), *(CONTENT if target is not None else ()))
    return plan_copies(rows, mark=F.col("mark"), target=target).drop("mark")


def period_folder(day: Column, mode: str) -> Column:
    return F.substring(day, 1, 4 if mode == "year" else 7)
