"""Model replies as text: fences off, JSON in several shapes, one row per item."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = "photo_id string, is_highlight boolean, reason string, event_tag string"
# fixed values: keys under which a reply may wrap its list, and keys that tell an event-level answer
WRAPPERS = ["results", "data", "items", "photos"]
EVENT_KEYS = ["photos", "images", "event_name", "event_description"]


def unfenced(text: Column) -> Column:
    """Text without surrounding code fences and white space."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n", ""), r"\s*```$", "")
    return F.when(F.startswith(s, F.lit("```")), F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(s)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once: the generator keeps the optimizer from copying it into every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parsed_whole(text: Column) -> Column:
    """Text as JSON inside an array, so that anything after the first value makes it invalid; null when it is no JSON."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _root(box: Column) -> Column:
    """The boxed value when it is alone, else the box itself (a bare comma-separated row of values)."""
    return F.when(F.try_variant_get(box, "$[1]", "variant").isNull(), F.try_variant_get(box, "$[0]", "variant")).otherwise(box)


def wrapped_list(v: Column, wrappers: list[str], lone_object: bool = True) -> Column:
    """The items of a reply: the array itself, the first wrapped list, or the lone object."""
    inner = F.filter(F.array(*[F.try_variant_get(v, f"$.{key}", "variant") for key in wrappers]), lambda x: F.coalesce(_kind(x), F.lit("")) == "ARRAY")
    boxed = F.coalesce(F.get(inner, F.lit(0)), F.when(F.lit(lone_object), v))
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(
        _kind(v) == "OBJECT", F.coalesce(F.try_variant_get(boxed, "$", "array<variant>"), F.when(F.lit(lone_object), F.array(v)))
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _objects_in(texts: pd.Series) -> pd.Series:
    """Top-level objects read one after the other until the text breaks off."""

    def read(s: str) -> list[str]:
        found, at = [], len(s) - len(s.lstrip(" \t\r\n["))
        while True:
            at += len(s[at:]) - len(s[at:].lstrip(" \t\r\n,"))
            if at >= len(s) or s[at] == "]":
                return found
            try:
                value, at = json.JSONDecoder().raw_decode(s, at)
            except json.JSONDecodeError:
                return found
            # objects and members of lists; a scalar between them is no item
            items = value if isinstance(value, list) else [value] if isinstance(value, dict) else []
            found += [json.dumps(x, ensure_ascii=False) for x in items]

    return texts.map(read)


def decision_items(replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reply) -> one row per decision in the reply, with its place ``at``.

    Whole-text JSON stays in the JVM; only replies that are no JSON as a whole go through the Arrow step.
    """
    clean = held(replies.select(*keys, "reply"), "text", unfenced(F.col("reply"))).where("text != ''")
    boxed = held(clean, "box", parsed_whole(F.col("text")))
    roots = held(boxed.where("box IS NOT NULL").select(*keys, "box"), "v", _root(F.col("box")))
    whole = held(roots, "list", wrapped_list(F.col("v"), WRAPPERS)).select(*keys, "list")
    broken = boxed.where("box IS NULL").select(*keys, F.transform(_objects_in("text"), lambda s: F.try_parse_json(s)).alias("list"))
    parsed = whole.unionByName(broken).where("size(list) > 0")
    head = F.get("list", F.lit(0))

    def has(key: str) -> Column:
        return F.try_variant_get(head, f"$.{key}", "variant").isNotNull()

    event_level = (_kind(head) == "OBJECT") & ~has("photo_id") & (has(EVENT_KEYS[0]) | has(EVENT_KEYS[1]) | has(EVENT_KEYS[2]) | has(EVENT_KEYS[3]))
    rows = parsed.where(F.coalesce(~event_level, F.lit(True))).select(*keys, F.posexplode("list").alias("at", "item")).where(_kind(F.col("item")) == "OBJECT")

    def text(key: str) -> Column:
        return F.try_variant_get("item", f"$.{key}", "string").alias(key)

    return rows.select(
        *keys, "at", text("photo_id"), F.coalesce(F.try_variant_get("item", "$.is_highlight", "boolean"), F.lit(False)).alias("is_highlight"),
        F.coalesce(text("reason"), F.lit("无")).alias("reason"), text("event_tag"),
    )


def merge_decision(replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reply) -> struct ``decision`` (should_merge, merged_name, reason); null when the reply is no JSON object."""
    box = held(held(replies.select(*keys, "reply"), "text", unfenced(F.col("reply"))), "box", parsed_whole(F.col("text")))
    v = held(box, "v", _root(F.col("box")))

    def text(key: str) -> Column:
        return F.coalesce(F.trim(F.try_variant_get("v", f"$.{key}", "string")), F.lit("")).alias(key)

    flag = F.coalesce(F.try_variant_get("v", "$.should_merge", "boolean"), F.lit(False)).alias("should_merge")
    return v.select(*keys, F.when(_kind(F.col("v")) == "OBJECT", F.struct(flag, text("merged_name"), text("reason"))).alias("decision"))


def _groups(replies: DataFrame, keys: list[str], wrapper: str) -> DataFrame:
    box = held(held(replies.select(*keys, "reply"), "text", unfenced(F.col("reply"))), "box", parsed_whole(F.col("text")))
    v = held(box.where("box IS NOT NULL").select(*keys, "box"), "v", _root(F.col("box")))
    return v.select(*keys, F.posexplode(wrapped_list(F.col("v"), [wrapper], lone_object=False)).alias("pos", "g"))


def theme_items(replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reply) -> (keys, theme, number, tag): each named theme with its members, by number or by tag."""
    groups = _groups(replies, keys, "groups").select(
        *keys, F.trim(F.try_variant_get("g", "$.theme", "string")).alias("theme"), F.explode(F.try_variant_get("g", "$.events", "array<variant>")).alias("e")
    )
    named = groups.where("theme != ''").withColumn("kind", _kind(F.col("e")))
    return named.select(
        *keys, "theme", F.when(F.col("kind") == "BIGINT", F.try_variant_get("e", "$", "int")).alias("number"),
        F.when(F.col("kind") == "STRING", F.trim(F.try_variant_get("e", "$", "string"))).alias("tag"),
    ).where("number IS NOT NULL OR tag != ''")


def merge_map(replies: DataFrame, known: DataFrame) -> DataFrame:
    """(at, reply) -> (theme, merged): groups with a name and two or more known themes; a later group wins."""
    members = _groups(replies, ["at"], "merges").select(
        "at", "pos", F.trim(F.try_variant_get("g", "$.merged_name", "string")).alias("merged"), F.explode(F.try_variant_get("g", "$.themes", "array<string>")).alias("theme")
    ).where("merged != ''").withColumn("theme", F.trim("theme"))
    valid = members.join(known.select("theme").distinct(), "theme", "left_semi")
    big = valid.groupBy("at", "pos").agg(F.count("*").alias("n")).where("n >= 2")
    return valid.join(big, ["at", "pos"]).groupBy("theme").agg(F.max_by("merged", F.struct("at", "pos")).alias("merged"))
