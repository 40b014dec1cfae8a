"""URL filters: host-suffix and path-prefix expressions, equi-join on short hash prefixes, full digests, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: hex digits of a digest that the join goes by
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first '://', A-Z lower-cased, and the path up to '?' or '#'; both empty for null or no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, url) and rules (host, path, verdict) -> page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's. A rule's path begins with
    '/' and ends with '/', or is whole; the longest rule wins, then the greatest text, then 'block'. Without a rule
    the verdict is ``default``. Each distinct (host, path) is expanded into the host suffixes and path prefixes as
    deep as the deepest rule, so that no rule can be missed and a url of a thousand labels stays small. Null urls
    and empty tables are fine; repeated rows are judged alike; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = F.concat("host", "path")
    listed = rules.select(
        rule.alias("rule"), F.col("verdict"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"),
        F.size(F.split("host", r"\.")).alias("labels"), F.size(F.split("path", "/")).alias("steps"),
    )
    deep, far = (x or 1 for x in listed.agg(F.max("labels"), F.max("steps")).first())
    urls = seen.where("host != ''").select("host", "path").distinct()
    parts, steps = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(parts), F.lit(deep)))),
        lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."),
    )
    # steps 1..n-1 end with '/', the whole path may not
    prefixes = F.array_distinct(F.concat(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(steps), F.lit(far)))), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.when(i < F.size(steps), "/").otherwise(""))),
        F.array(F.lit("")),
    ))
    forms = urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select(
        "host", "path", F.explode(F.transform("prefixes", lambda p: F.sha2(F.concat_ws("\n", "suffix", p), 256))).alias("digest")
    )
    short = F.substring("digest", 1, SHORT)
    hits = forms.withColumn("short", short).join(listed.select(short.alias("short"), F.col("digest").alias("whole"), "rule", "verdict"), "short").where("digest = whole")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return seen.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
