"""Comparison of several models' verdicts on the same photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chinese_tokens(text: Column) -> Column:
    """Runs of two or more Chinese characters."""
    return F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0))


# fixed values: log line shapes
KEPT = r"\[√\] 提取 -> ([^\|]+?) \| ([^\|]+?) \| (.+)"
DROPPED = r"\[×\] 剔除 -> ([^\|]+?) \| (.+)"
META = {
    "input_dir": r"\[Input\]\s+(.*?)\s+\[Output\]",
    "provider": r"\[Provider\]\s+(\w+)\s+\[Model\]\s+.+",
    "model": r"\[Provider\]\s+\w+\s+\[Model\]\s+(.+)",
    "extraction_level": r"\[提取档位\]\s+([ABC])",
    "token_total": r"总 token:\s+([\d,]+)",
    "deleted": r"02阶段 LLM 剔除:\s+(\d+)\s+张",
    "deleted_after_dedup": r"合并去重后总计:\s+(\d+)\s+张",
}


def log_decisions(lines: DataFrame) -> DataFrame:
    """(file, at, line) -> one verdict per file and photo, the last line wins."""
    line = F.trim("line")
    kept = F.regexp_extract(line, KEPT, 1) != ""
    photo = F.when(kept, F.regexp_extract(line, KEPT, 1)).otherwise(F.regexp_extract(line, DROPPED, 1))
    rows = lines.select(
        "file", "at", F.trim(photo).alias("photo_id"), F.when(kept, "keep").otherwise("delete").alias("decision"),
        F.trim(F.when(kept, F.regexp_extract(line, KEPT, 2)).otherwise("")).alias("event_tag"),
        F.trim(F.when(kept, F.regexp_extract(line, KEPT, 3)).otherwise(F.regexp_extract(line, DROPPED, 2))).alias("reason"),
    ).where("photo_id != ''")
    last = rows.groupBy("file", "photo_id").agg(F.max_by(F.struct("decision", "event_tag", "reason"), "at").alias("d"))
    return last.select("file", "photo_id", "d.*")


def log_metadata(lines: DataFrame) -> DataFrame:
    """One row per log: run settings from their first line, kept and judged counts."""
    def first(pattern: str) -> Column:
        got = F.trim(F.regexp_extract("line", pattern, 1))
        return F.min_by(got, F.when(got != "", F.col("at")))

    per = lines.groupBy("file").agg(
        *[first(p).alias(k) for k, p in META.items()],
        F.count_if(F.contains("line", F.lit("[√] 提取 ->"))).alias("kept"),
        F.count_if(F.contains("line", F.lit("[√] 提取 ->")) | F.contains("line", F.lit("[×] 剔除 ->"))).alias("total_photos"),
    )
    ints = {k: F.replace(k, F.lit(",")).cast("bigint") for k in ("token_total", "deleted", "deleted_after_dedup")}
    return per.withColumns(ints)


def run_keys(meta: DataFrame) -> DataFrame:
    """``run_key`` per log: provider and short model name, #2, #3 ... for repeats in file order (one row per log)."""
    short = F.substring(F.element_at(F.split("model", "/"), -1), 1, 20)
    base = F.concat(F.coalesce("provider", F.lit("unknown")), F.lit("-"), F.coalesce(short, F.lit("unknown")))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("file"))
    return meta.withColumn("base", base).withColumn("nth", nth).withColumn(
        "run_key", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), F.col("nth").cast("string")))
    ).drop("base", "nth")


def same_input_errors(meta: DataFrame) -> DataFrame:
    """Attributes in which the compared logs differ; one row too for fewer than two logs."""
    per = meta.agg(
        F.count("*").alias("logs"), *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))).alias(c) for c in ("input_dir", "total_photos", "extraction_level")]
    )
    few = F.when(F.col("logs") < 2, F.array(F.struct(F.lit("logs").alias("attribute"), F.col("logs").alias("variants"))))
    checks = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("variants")) for c in ("input_dir", "total_photos", "extraction_level")])
    return per.select(F.explode(F.coalesce(few, F.filter(checks, lambda x: x["variants"] > 1))).alias("e")).select("e.*")


def comparison_table(decisions: DataFrame, models: list[str]) -> DataFrame:
    """One row per photo, one decision column per model (MISSING when absent), and the consensus."""
    wide = decisions.groupBy("photo_id").pivot("model", models).agg(F.first("decision").alias("decision"))
    for m in models:
        wide = wide.withColumn(m, F.coalesce(m, F.lit("MISSING")))
    seen = F.array_distinct(F.filter(F.array(*models), lambda d: d != "MISSING"))
    verdict = F.when(F.size(seen) == 1, "一致").when(F.size(seen) == 0, "全MISSING").otherwise("不一致")
    return wide.withColumn("consensus", verdict)


def consensus_counts(table: DataFrame) -> DataFrame:
    """Photos and share per consensus class."""
    per = table.groupBy("consensus").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).scalar()
    return per.select("consensus", "n", F.round(F.col("n") * 100.0 / total, 1).alias("pct"))


def disagreements(table: DataFrame, models: list[str]) -> DataFrame:
    """Photos judged differently: the only keeper, the only deleter, or mixed."""
    def who(decision: str) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(m) == decision, F.lit(m)) for m in models]))

    pattern = (
        F.when(F.size(who("keep")) == 1, F.concat(F.lit("only_"), F.get(who("keep"), F.lit(0)), F.lit("_kept")))
        .when(F.size(who("delete")) == 1, F.concat(F.lit("only_"), F.get(who("delete"), F.lit(0)), F.lit("_deleted")))
        .otherwise("complex_disagreement")
    )
    return table.where("consensus = '不一致'").select("photo_id", pattern.alias("pattern"))


def run_stats(decisions: DataFrame) -> DataFrame:
    """Per model: judged, kept, deleted, keep rate."""
    kept = F.count_if(F.col("decision") == "keep")
    return decisions.groupBy("model").agg(
        F.count("*").alias("total"), kept.alias("kept"), (F.count("*") - kept).alias("deleted"), F.round(kept * 100.0 / F.count("*"), 1).alias("keep_pct")
    )


def word_counts(decisions: DataFrame, tokens: Column) -> DataFrame:
    """(model, decision, word, n) of texts that stand in the decision rows."""
    return decisions.select("model", "decision", F.explode(tokens).alias("word")).groupBy("model", "decision", "word").agg(F.count("*").alias("n"))


def document_word_counts(decisions: DataFrame, documents: DataFrame, tokens: Column, key: str) -> DataFrame:
    """The same for texts shared by several decisions.

    A document is given its set of (model, decision) first, a few different ones in all; texts without a decision are left
    out before they are cut. Words are counted per set, so tasks sum up before anything is moved, and the counts go to
    the members of each set at the end. Documents are read once; a model that judges a document twice alike counts twice.
    """
    told = decisions.groupBy(key, "model", "decision").agg(F.count("*").alias("times"))
    sets = told.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("model", "decision", "times"))).alias("verdicts"))
    words = documents.join(sets, key).select("verdicts", F.explode(tokens).alias("word"))
    counted = words.groupBy("verdicts", "word").agg(F.count("*").alias("n"))
    each = counted.select("word", "n", F.explode("verdicts").alias("v")).select("v.*", "word", "n")
    return each.groupBy("model", "decision", "word").agg(F.sum(F.col("n") * F.col("times")).alias("n"))


def sketched_words(decisions: DataFrame, documents: DataFrame, tokens: Column, key: str, k: int = 10, tracked: int = 10_000) -> DataFrame:
    """(model, decision, word, about): the k most frequent words by a mergeable sketch that tracks so many of them.

    A sketch per (model, decision) has a fixed size however many different words there are, where the exact count moves
    each of them. A word that is not among the tracked ones is rarer than ``sketch_error``.
    """
    words = documents.join(decisions.select(key, "model", "decision"), key).select("model", "decision", F.explode(tokens).alias("word"))
    top = words.groupBy("model", "decision").agg(F.expr(f"approx_top_k(word, {int(k)}, {int(tracked)})").alias("top"))
    return top.select("model", "decision", F.explode("top").alias("t")).select("model", "decision", F.col("t.item").alias("word"), F.col("t.count").alias("about"))


def sketch_error(all_words: Column, tracked: int = 10_000) -> Column:
    """The most that a sketched count is off: 3.5 of as many parts as the sketch's table has, a power of two that tracks 3/4."""
    table = 1 << max(3, (int(tracked / 0.75) - 1).bit_length())
    return F.ceil(all_words * (3.5 / table))


def sketch_against_exact(sketch: DataFrame, exact: DataFrame, tracked: int = 10_000) -> DataFrame:
    """Per model and decision: words counted, whether each sketched count is within the error, top words that the sketch missed by more.

    ``exact`` is (model, decision, word, n).
    """
    totals = exact.groupBy("model", "decision").agg(F.sum("n").alias("all_words")).withColumn("error", sketch_error(F.col("all_words"), tracked))
    both = keywords(exact).drop("all_words").withColumn("exact_top", F.lit(True)).select("model", "decision", "word", "n", "exact_top")
    near = sketch.join(exact, ["model", "decision", "word"], "left").join(totals, ["model", "decision"])
    inside = near.groupBy("model", "decision").agg(F.bool_and(F.abs(F.col("about") - F.coalesce("n", F.lit(0))) <= F.col("error")).alias("within"), F.min("about").alias("least"), F.count("*").alias("told"))
    missed = both.join(sketch.select("model", "decision", "word"), ["model", "decision", "word"], "left_anti").groupBy("model", "decision").agg(F.max("n").alias("largest"))
    rows = totals.join(inside, ["model", "decision"]).join(missed, ["model", "decision"], "left")
    return rows.select("model", "decision", "all_words", "told", "within", (F.coalesce("largest", F.lit(0)) > F.col("least") + 2 * F.col("error")).alias("missed"))


def keywords(words: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent words per model and decision, with the count of all words there; ties by word."""
    total = words.groupBy("model", "decision").agg(F.sum("n").alias("all_words"))
    w = Window.partitionBy("model", "decision").orderBy(F.desc("n"), "word")
    # the rank limit is applied before the shuffle too, so few rows per task reach the window
    top = words.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(total, ["model", "decision"])


def extraction_rates(counts: DataFrame) -> DataFrame:
    """(level, archived, in_pipeline, scanned) -> both rates and whether the first lies in the level's band."""
    # fixed values: accepted bands per level
    low = F.when(F.col("level") == "A", 0.20).when(F.col("level") == "B", 0.50).when(F.col("level") == "C", 0.99)
    high = F.when(F.col("level") == "A", 0.45).when(F.col("level") == "B", 0.80).when(F.col("level") == "C", 1.00)
    rate = F.col("archived") / F.nullif(F.col("in_pipeline"), F.lit(0))
    return counts.select(
        "*", F.round(rate, 6).alias("rate_in_pipeline"), F.round(F.col("archived") / F.nullif(F.col("scanned"), F.lit(0)), 6).alias("rate_scanned"), rate.between(low, high).alias("within_band")
    )
