"""Batched decisions: asking a scorer, retrying what it left out, applying the verdicts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumloom.functions.names import basename, clean_tag, dated_tag, saved_name
from albumloom.functions.replies import decision_items
from albumloom.functions.rules import error_class
from albumloom.operators.naming import CONTENT, plan_copies
from albumloom.operators.ordering import in_order, running_max
from albumloom.params import Curation
from albumloom.session import settle

# a scorer turns request rows (key, tier, lines) into (key, reply, finish_reason, output_tokens)
Scorer = Callable[[pd.DataFrame], pd.DataFrame]
REPLY = "key string, reply string, finish_reason string, output_tokens bigint"


def photo_line() -> Column:
    """Request line of one photo: number, time of day, place when known."""
    parts = ((86400, 3600), (3600, 60), (60, 1))
    time = F.concat_ws(":", *[F.lpad(F.floor(F.col("t") % m / d).cast("string"), 2, "0") for m, d in parts])
    place = F.when(F.coalesce("place", F.lit("")) != "", F.concat(F.lit("，地点: "), "place")).otherwise("")
    return F.concat(F.lit("照片编号: "), "item_id", F.lit("，时间: "), time, place)


def requests(items: DataFrame, key: list[str], line: Column) -> DataFrame:
    """One row per batch: ids and request lines in order. A batch holds at most ten items."""
    got = F.array_sort(F.collect_list(F.struct("rank", "item_id", line.alias("line"))))
    return items.groupBy(*key).agg(got.alias("got")).select(
        *key, F.transform("got", lambda g: g["item_id"]).alias("ids"), F.array_join(F.transform("got", lambda g: g["line"]), "\n").alias("lines")
    )


def score(asked: DataFrame, scorer: Scorer) -> DataFrame:
    """Run the scorer over request rows in Arrow batches; each row is one model call."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield scorer(pdf)

    return asked.mapInPandas(run, REPLY)


def sample_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeatable stand-in for a model: verdicts and gaps follow from md5 digits of tier and id."""
    from hashlib import md5

    gaps = {"T1": "012", "T2": "01234567", "T3": "0123"}

    def digit(text: str) -> str:
        return md5(text.encode()).hexdigest()[0]

    out = []
    for key, tier, ids in zip(pdf["key"], pdf["tier"], pdf["ids"]):
        told = [i for i in ids if digit(tier + i) not in gaps[tier]]
        items = [{"photo_id": i, "is_highlight": digit(i) > "7", "reason": "r" + digit(i), "event_tag": "散步" + digit(i)} for i in told]
        items.append({"photo_id": "made_up.jpg", "is_highlight": True, "reason": "x", "event_tag": "y"})
        out.append((key, json.dumps(items, ensure_ascii=False), "stop", 20 * len(items)))
    return pd.DataFrame(out, columns=["key", "reply", "finish_reason", "output_tokens"])


def valid_items(parsed: DataFrame, sent: DataFrame, key: list[str]) -> DataFrame:
    """Decisions about items that were sent; the first one per item."""
    known = parsed.join(sent.select(*key, F.col("item_id").alias("photo_id")), [*key, "photo_id"], "left_semi")
    cols = F.struct("is_highlight", "reason", "event_tag")
    return known.groupBy(*key, F.col("photo_id").alias("item_id")).agg(F.min_by(cols, "at").alias("d")).select(*key, "item_id", "d.*")


def _replies(items: DataFrame, scorer: Scorer, tier: str, key: list[str]) -> DataFrame:
    """One call per batch: its key columns again, the reply and how it ended."""
    asked = requests(items, key, photo_line()).withColumn("key", F.concat_ws("\u0001", *key)).withColumn("tier", F.lit(tier))
    replies = score(asked.select("key", "tier", "ids", "lines"), scorer)
    parts = F.split("key", "\u0001")
    return replies.select(*[F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(key)], "reply", "finish_reason")


def _told(replies: DataFrame, items: DataFrame, tier: str, key: list[str]) -> DataFrame:
    """Decisions of the replies about the items that were sent; written out, since a model does not repeat itself."""
    got = valid_items(decision_items(replies, key), items.withColumns({k: F.col(k).cast("string") for k in key}), key)
    return settle(got.withColumn("tier", F.lit(tier)))


def ask(items: DataFrame, scorer: Scorer, tier: str, key: list[str]) -> DataFrame:
    """One tier: request, score, parse, keep what was asked for."""
    return _told(_replies(items, scorer, tier, key), items, tier, key)


def three_tiers(items: DataFrame, scorer: Scorer, p: Curation = Curation()) -> tuple[DataFrame, DataFrame]:
    """Answers of all tiers and the items that got none. Items: batch_id, item_id, rank, t, place, ..."""
    on = ["batch_id", "item_id"]
    t1 = ask(items, scorer, "T1", ["batch_id"])
    left = items.join(t1.select(*on), on, "left_anti")
    t2 = ask(left, scorer, "T2", ["batch_id"])
    left = left.join(t2.select(*on), on, "left_anti")
    # batches hold at most ten items, so this window is bounded
    turn = F.row_number().over(Window.partitionBy("batch_id").orderBy("rank"))
    small = left.withColumn("sub", F.floor((turn - 1) / p.retry_group).cast("string"))
    t3 = ask(small, scorer, "T3", ["batch_id", "sub"]).drop("sub")
    return t1.unionByName(t2).unionByName(t3), left.join(t3.select(*on), on, "left_anti")


TIERS = ("T1", "T2", "T3")
CALL = ["batch_id", "step", "sub"]


def guarded_tiers(items: DataFrame, scorer: Scorer, p: Curation = Curation()) -> tuple[DataFrame, DataFrame]:
    """(items with ``state``, calls): all tiers, stopped by the breaker.

    Calls are made batch by batch in order of batch_id, in a batch tier by tier and in the third group by group. A call whose
    finish_reason is ``error`` has failed, its reply is the message. The first fatal failure, or the last of so many failures in
    a row, trips the breaker: later calls are not made. State is the tier that answered, ``failed`` for what all its calls left out, and
    ``not_asked`` where the breaker came first; such items are no failures and are asked by the next run.

    Tiers are asked one after the other for all batches that no fatal failure found so far lies before, so the smallest
    such batch shuts the later tiers. Rows in a row of failures are told once all calls are known; what they or a fatal call of a later tier
    would have prevented is left out again. ``calls`` are those made: batch_id, step, sub, ok, fatal.
    """
    items = settle(items)
    on = ["batch_id", "item_id"]
    left, answers, calls, shut = items, [], [], None
    for step, tier in enumerate(TIERS, 1):
        if shut is not None:
            left = left.where(F.col("batch_id") < F.lit(shut))
        if tier == "T3":
            # batches hold at most ten items, so this window is bounded
            turn = F.row_number().over(Window.partitionBy("batch_id").orderBy("rank"))
            left = left.withColumn("sub", F.floor((turn - 1) / p.retry_group).cast("string"))
        key = ["batch_id", "sub"] if tier == "T3" else ["batch_id"]
        replies = settle(_replies(left, scorer, tier, key))
        bad = F.coalesce(F.col("finish_reason") == "error", F.lit(False))
        sub = F.col("sub") if tier == "T3" else F.lit("0")
        made = replies.select("batch_id", F.lit(step).alias("step"), sub.cast("int").alias("sub"), (~bad).alias("ok"), (bad & (error_class(F.col("reply")) == "fatal")).alias("fatal"))
        calls.append(made)
        got = _told(replies.where(~bad), left, tier, key)
        answers.append(got.select(*on, "is_highlight", "reason", "event_tag", "tier", F.lit(step).alias("step"), sub.cast("int").alias("sub")))
        first = made.where("fatal").agg(F.min("batch_id")).first()[0]  # one name
        shut = first if shut is None else min(shut, first or shut)
        left = left.join(got.select(*on), on, "left_anti")
    every = settle(reduce(DataFrame.unionByName, calls))
    placed = running_max(in_order(every, [], CALL), [], {"last_ok": F.when(F.col("ok"), F.col("pos"))})
    row = F.col("pos") - F.coalesce("last_ok", F.lit(-1))
    tripped = F.col("fatal") | (~F.col("ok") & (row >= p.failure_limit))
    trip = placed.where(tripped).agg(F.min(F.struct(*CALL)).alias("at")).first()["at"]  # one call
    got = reduce(DataFrame.unionByName, answers)
    rows = items.join(got.drop("tier").withColumn("tier", F.element_at(F.array(*map(F.lit, TIERS)), F.col("step"))), on, "left")
    if trip is None:
        return rows.withColumn("state", F.coalesce("tier", F.lit("failed"))).drop("tier", "step", "sub"), every
    at = F.struct(*[F.lit(trip[c]).cast(t).alias(c) for c, t in zip(CALL, ("string", "int", "int"))])
    before = F.struct(*CALL) < at
    state = F.when(F.col("tier").isNotNull() & before, F.col("tier")).when(F.col("batch_id") < F.lit(trip["batch_id"]), "failed").otherwise("not_asked")
    blank = {c: F.when(F.col("state").isin(*TIERS), F.col(c)) for c in ("is_highlight", "reason", "event_tag")}
    return rows.withColumn("state", state).withColumns(blank).drop("tier", "step", "sub"), every.where(F.struct(*CALL) <= at)


def retry_truncated(asked: DataFrame, scorer: Scorer) -> DataFrame:
    """Replies with one retry for those cut short; cut short twice means no reply. ``attempts`` counts the calls."""
    def cut() -> Column:
        return (F.col("finish_reason") == "length") | ((F.trim("reply") == "") & (F.col("output_tokens") > 0))

    first = settle(score(asked.withColumn("attempt", F.lit(1)), scorer))
    again = asked.join(first.where(cut()).select("key"), "key", "left_semi").withColumn("attempt", F.lit(2))
    second = settle(score(again, scorer))
    return first.where(~cut()).withColumn("attempts", F.lit(1)).unionByName(
        second.withColumn("reply", F.when(~cut(), F.col("reply"))).withColumn("attempts", F.lit(2))
    )


def overridden(decisions: DataFrame, p: Curation = Curation()) -> DataFrame:
    """Decisions with the keep-everything override; ``rejected`` stays the model's own verdict."""
    bare = F.coalesce("event_tag", F.lit("")) == ""
    none = bare | (F.lower(F.trim("event_tag")) == "null")
    out = decisions.withColumn("rejected", ~F.col("is_highlight"))
    if p.force_keep:
        spare = F.when(none & ((F.col("reason") == "无") | (F.col("reason") == "")), "归类档兜底").otherwise(F.col("reason"))
        out = out.withColumns({"is_highlight": F.lit(True), "reason": spare, "event_tag": F.when(none, F.concat("day", F.lit("-未分类"))).otherwise(F.col("event_tag"))})
    return out.withColumn("kept", F.col("is_highlight") & (F.coalesce("event_tag", F.lit("")) != "") & (F.lower(F.trim("event_tag")) != "null"))


def with_files(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions with the path, time and exactness of the photo they are about."""
    return decisions.join(items.select("batch_id", "item_id", "path", "t", "is_exact", "day"), ["batch_id", "item_id"])


def apply_decisions(decisions: DataFrame, items: DataFrame, p: Curation = Curation(), target: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(copy plan, removal entries) of scored items. With a listing of the target, items bring size and md5, equal files are
    left and a source whose digest name is another file's is a conflict."""
    rows = overridden(with_files(decisions, items), p)
    if target is not None:
        rows = rows.join(items.select("path", *CONTENT).distinct(), "path")
    tag = clean_tag(dated_tag(F.col("day"), F.col("event_tag")))
    name = saved_name(basename(F.col("path")), F.col("is_exact"))
    content = CONTENT if target is not None else ()
    wanted = rows.where("kept").select(tag.alias("folder"), name.alias("name"), F.col("path").alias("src"), *content).distinct()
    plan = plan_copies(wanted, target=target, numbered=target is None)
    return plan, removals(rows)


def removals(rows: DataFrame) -> DataFrame:
    """(name, epoch) of everything the model rejected."""
    return rows.where("rejected").select(basename(F.col("path")).alias("name"), F.coalesce("t", F.lit(-1).cast("bigint")).alias("epoch"))


def copy_times(dropped: DataFrame, known: DataFrame) -> DataFrame:
    """(name, epoch) of removed copies, -1 where ``known`` (path, t) does not list the path."""
    k = known.select("path", F.col("t").alias("epoch"))
    return dropped.join(k, "path", "left").select(F.col("filename").alias("name"), F.coalesce("epoch", F.lit(-1).cast("bigint")).alias("epoch"))


def removal_list(*parts: DataFrame) -> DataFrame:
    """Distinct entries of all parts, ordered by name and time."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.distinct().orderBy("name", "epoch")


def failed_files(failed: DataFrame) -> DataFrame:
    """Distinct failed paths, the first per file name."""
    return failed.select(basename(F.col("path")).alias("name"), "path").groupBy("name").agg(F.min("path").alias("path"))


# fixed values: currency units per million tokens: new input, cached input, output
PRICES = [
    ("gemma4:31b", 0.0, 0.0, 0.0, "RMB"), ("qwen3.6:27b", 0.0, 0.0, 0.0, "RMB"), ("hf.co/unsloth/gemma-4-31B-it-qat-GGUF:UD-Q4_K_XL", 0.0, 0.0, 0.0, "RMB"),
    ("doubao-seed-2-0-lite-260428", 0.6, 0.12, 3.6, "RMB"), ("qwen3.7-plus", 1.6, 0.32, 6.4, "RMB"), ("qwen3.6-flash", 1.2, 0.12, 7.2, "RMB"),
    ("kimi-k2.6", 6.5, 1.1, 27.0, "RMB"), ("moonshot-v1-32k-vision-preview", 5.0, 5.0, 20.0, "RMB"), ("deepseek-v4-pro", 3.0, 0.025, 6.0, "RMB"),
    ("mimo-v2.5", 1.0, 0.02, 2.0, "RMB"), ("gpt-4o", 2.5, 1.25, 10.0, "USD"),
]


def token_totals(calls: DataFrame) -> DataFrame:
    """Per tier and overall (tier null): calls, new, cached and output tokens; ``tier_input`` counts the full prompt."""
    return calls.rollup("tier").agg(
        F.count("*").alias("calls"),
        F.sum(F.greatest(F.col("prompt_tokens") - F.col("cached_tokens"), F.lit(0))).alias("fresh"),
        F.sum("cached_tokens").alias("cached"),
        F.sum("output_tokens").alias("output"),
        F.sum("prompt_tokens").alias("tier_input"),
    )


def cost_estimate(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Per model: tokens times price per million, null where no price is known."""
    used = calls.groupBy("model").agg(
        F.sum(F.greatest(F.col("prompt_tokens") - F.col("cached_tokens"), F.lit(0))).alias("fresh"), F.sum("cached_tokens").alias("cached"), F.sum("output_tokens").alias("output")
    )
    cost = {k: F.col(c) / 1000000 * F.col(k) for k, c in (("input_price", "fresh"), ("cached_price", "cached"), ("output_price", "output"))}
    total = cost["input_price"] + cost["cached_price"] + cost["output_price"]
    return used.join(prices, "model", "left").select(
        "model", "currency", F.round(cost["input_price"], 4).alias("cost_input"), F.round(cost["cached_price"], 4).alias("cost_cached"),
        F.round(cost["output_price"], 4).alias("cost_output"), F.round(total, 4).alias("cost_total"),
    )


def run_performance(calls: DataFrame) -> DataFrame:
    """Tokens per call and calls per minute of each run."""
    minutes = F.nullif((F.max("t") - F.min("t")) / F.lit(60.0), F.lit(0.0))
    fresh = F.sum(F.greatest(F.col("prompt_tokens") - F.col("cached_tokens"), F.lit(0)))
    n = F.count("*")
    return calls.groupBy("run").agg(
        F.round(fresh / n, 4).alias("fresh_per_call"), F.round(F.sum("cached_tokens") / n, 4).alias("cached_per_call"),
        F.round(F.sum("output_tokens") / n, 4).alias("output_per_call"), F.round(n / minutes, 6).alias("calls_per_minute"),
    )
