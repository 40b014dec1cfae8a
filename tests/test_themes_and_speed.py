"""Theme names, keyword sketches and running speed against plain Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from albumloom.operators import compare, progress, themes
from albumloom.params import Curation, Themes


def test_final_names(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("p", "q"), ("q", "p"), ("r", "q"), ("s", "s")]
    got = {tuple(r) for r in themes.final_names(spark.createDataFrame(rows, "theme string, merged string")).collect()}
    assert got == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "d"), ("p", "p"), ("q", "p"), ("r", "p")}


def halving(pdf):
    """Joins each two themes of a list, by number."""
    import json

    out = [(k, json.dumps([{"merged_name": min(a, b), "themes": [a, b]} for a, b in zip(ids[::2], ids[1::2])]), "stop", 1) for k, ids in zip(pdf["key"], pdf["ids"])]
    return pd.DataFrame(out, columns=["key", "reply", "finish_reason", "output_tokens"])


def test_many_lists(spark):
    """More themes than a list holds: asked in rounds until one list is left, no event lost and no theme asked alone."""
    members = spark.createDataFrame([(f"t{i % 20:02}", f"e{i}") for i in range(60)], "theme string, tag string")
    got = themes.merged_themes(members, halving, Themes(theme_batch=4)).collect()
    assert len({r["theme"] for r in got}) <= 2 and sorted(r["tag"] for r in got) == sorted(f"e{i}" for i in range(60))
    one = spark.createDataFrame([("t", "e")], "theme string, tag string")
    assert [tuple(r) for r in themes.merged_themes(one, halving).collect()] == [("t", "e")]


@pytest.mark.parametrize("stretch", [1, 8192])
def test_throughput_over_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(progress, "STRETCH", stretch)
    rng = random.Random(2)
    done = [(run, rng.randrange(400)) for run in (1, 2) for _ in range(150)] + [(3, 7)]
    p = Curation(window_seconds=30)
    df, totals = spark.createDataFrame(done, "run bigint, t bigint"), spark.createDataFrame([(1, 200), (2, 150), (3, 1)], "run bigint, total bigint")
    got = {(r["run"], r["t"]): (r["done"], r["recent"]) for r in progress.throughput(df, totals, p).collect()}
    want = {}
    for run, t in set(done):
        mine = [x for r, x in done if r == run]
        if t > min(mine):
            want[run, t] = (sum(x <= t for x in mine), sum(t - 30 <= x <= t for x in mine))
    assert got == want


def test_throughput_of_a_long_run(spark):
    """One run of ten million seconds: nothing but one row per stretch is put in order by run alone."""
    done = spark.range(10_000_000).select(F.lit(1).cast("bigint").alias("run"), F.col("id").alias("t"))
    out = progress.throughput(done, spark.createDataFrame([(1, 10_000_000)], "run bigint, total bigint"))
    assert out.agg(F.count("*"), F.max("done"), F.max("recent"), F.sum("done")).first() == (9_999_999, 10_000_000, 301, 10_000_000 * 10_000_001 // 2 - 1)


def test_word_counts_by_set(spark):
    """A document judged by several models, alike twice, and one judged by none."""
    told = spark.createDataFrame([(1, "A", "keep"), (1, "B", "drop"), (1, "A", "keep"), (2, "A", "keep")], "doc bigint, model string, decision string")
    docs = spark.createDataFrame([(1, "x y x"), (2, "x"), (3, "x x x"), (4, None)], "doc bigint, body string")
    got = {(r["model"], r["decision"], r["word"]): r["n"] for r in compare.document_word_counts(told, docs, F.split("body", " "), "doc").collect()}
    assert got == {("A", "keep", "x"): 5, ("A", "keep", "y"): 2, ("B", "drop", "x"): 2, ("B", "drop", "y"): 1}


def test_sketch_keeps_to_its_error(spark):
    """A sketch too small for the words: counts stay within the bound and the frequent word is found."""
    rng = random.Random(3)
    words = ["hot"] * 3000 + [f"w{rng.randrange(5000)}" for _ in range(12000)]
    rng.shuffle(words)
    df = spark.createDataFrame([(i, " ".join(words[i * 15 : i * 15 + 15])) for i in range(1000)], "doc bigint, body string").repartition(6)
    told = df.select("doc", F.lit("A").alias("model"), F.lit("keep").alias("decision"))
    tokens = F.split("body", " ")
    sketch = compare.sketched_words(told, df, tokens, "doc", k=5, tracked=100)
    row = compare.sketch_against_exact(sketch, compare.document_word_counts(told, df, tokens, "doc"), tracked=100).first()
    assert row["within"] and not row["missed"] and row["all_words"] == 15000
    assert sketch.orderBy(F.desc("about")).first()["word"] == "hot"
