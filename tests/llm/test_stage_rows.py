"""Repeated and missing ids: near-duplicate components, and which rows the pipeline's stages leave."""

import random
from collections import Counter

import corpus_pipeline
from albumloom.llm import common, mixing, neardup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def words(tag, n=40):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_documents_of_several_texts(spark):
    """1 and 2 are linked by 3, which has the texts of both; 5 has the texts of 4 and 6, 6 has a near copy of that of 7."""
    rows = [(1, words("a")), (2, words("b")), (3, words("a")), (3, words("b")), (4, words("c")), (5, words("c")), (5, words("d")), (6, words("d")), (6, words("e")), (7, words("e") + " x"), (8, words("f")), (8, "")]
    got = {}
    for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        if r["n_shingles"]:
            got.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert got == {1: {(1, True)}, 2: {(1, False)}, 3: {(1, False)}, 4: {(4, True)}, 5: {(4, False)}, 6: {(4, False)}, 7: {(4, False)}, 8: {(8, True)}}


def test_documents_of_several_texts_against_search(spark):
    """Random ids over few texts, against a search over the graph of ids and texts."""
    rng = random.Random(4)
    rows = [(rng.randrange(60), words(f"t{rng.randrange(45)}_")) for _ in range(90)]
    group = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for key in (0, 1):
            low = {}
            for r in rows:
                low[r[key]] = min(low.get(r[key], group[r[0]]), group[r[0]])
            for r in rows:
                if low[r[key]] < group[r[0]]:
                    group[r[0]], changed = low[r[key]], True
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and all(r["component_id"] == group[r["doc_id"]] for r in got)


def test_equal_rows_share_a_budget(spark):
    """200 rows without an id and with one text: the copies written meet the mix to one document."""
    rows = [(None, "ten words are in this text of ours every time", "en", "a", 1)] * 200 + [(i, words(f"s{i}_", 10), "en", "b", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    sources = {r["source"]: r for r in mixing.mix(docs).collect()}
    out = Counter(r["source"] for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    for source, r in sources.items():
        assert 0 <= out[source] * 10 - r["target"] < 10
    assert sum(r["taken"] for r in mixing.mix(docs).collect()) == sum(int(r["target"] + 0.5) for r in sources.values())


def test_mix_takes_each_row_once_more_by_order(spark):
    """The stage against plain Python: rows in the order of the key, whole epochs first, halves rounded up; repeated ids with different texts."""
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(30)]), " ".join(["w"] * rng.randrange(0, 9)) + f" {rng.randrange(40)}", "en", rng.choice("abc"), 1) for _ in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    keyed = docs.withColumn("key", mixing.mix_key(docs)).collect()
    targets = {r["source"]: (r["target"], r["source_size"]) for r in mixing.mix(docs).collect()}
    want = Counter()
    for source, (target, size) in targets.items():
        budget = int(target + 0.5)
        mine = sorted((r for r in keyed if r["source"] == source), key=lambda r: r["key"] % 2**64)
        left = budget % size
        for r in mine:
            n = len(r["text"].split())
            copies = budget // size + (left > 0 and n > 0)
            left -= n
            if n:
                want[r["doc_id"], r["text"], source] += copies
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    assert got == +want


def test_stages_choose_alike_over_partitionings(spark):
    rows = [(i % 40, words(f"p{i % 7}_{i}_", 12 + i % 5), "en", "abc"[i % 3], i) for i in range(120)] + [(None, words("n"), None, None, None)] * 3
    found = []
    for n in (1, 3, 7):
        docs = common.stored(spark.createDataFrame(rows, DOCS).repartition(n), "stage")
        left = common.stored(corpus_pipeline.one_of_each(spark, docs, SF), "stage")
        assert Counter(r["doc_id"] for r in left.collect()) == Counter({**{i: 1 for i in range(40)}, None: 3})
        found.append((sorted(map(tuple, left.collect()), key=str), sorted(map(tuple, corpus_pipeline.mixed(spark, left, SF).collect()), key=str)))
    assert found[0] == found[1] == found[2]


def test_only_rows_that_hold_an_item_go(spark):
    """Of rows without an id, and of rows of one id, just those whose text holds a benchmark item."""
    item = max((r["text"] for r in common.table(spark, SF, "benchmark").collect()), key=len)
    clean = words("c")
    rows = [(None, clean, "en", "a", 1), (None, f"{clean} {item} {clean}", "en", "a", 2), (5, clean, "en", "a", 3), (5, item, "en", "a", 4), (6, None, "en", "a", 5), (7, "", "en", "a", 6)]
    left = corpus_pipeline.without_benchmark(spark, spark.createDataFrame(rows, DOCS).withColumn("_held", common.F.lit("clash")), SF)
    assert sorted(r["n_chars"] for r in left.collect()) == [1, 3, 5, 6] and left.columns[-1] == "_held"
