"""Near-dedup, token counts, language, toxicity, quality and the pipeline against plain Python and held-out labels."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from albumloom.llm import common, decontam, language, mixing, neardup, quality, queries, sharding, tokencount, toxicity
from tests.llm.test_native import DOCS, SF, empty, odd_docs, shingled, words

MEDIUM = "/root/testdata/sf0.01"


def lowered(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in words(text)]


def sets_of(rows, n):
    return {d: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := lowered(t)) else set() for d, t in rows}


def grouped(sets):
    """Smallest id of each component, by all pairs."""
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {d: top(d) for d in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, n):
    docs = common.table(spark, MEDIUM, "documents")
    got = neardup.near_duplicates(docs, neardup.NearDup(words=n)).collect()
    sets = sets_of([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], n)
    want = grouped(sets)
    assert Counter(map(tuple, got)) == Counter((d, len(s), want[d], want[d] == d) for d, s in sets.items())
    assert any(not r["kept"] for r in got)


def test_near_duplicates_of_a_template(spark):
    """Chains and stars of copies around one text, edited at random: buckets that need more than one round."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10_000)}"
        rows.append((i * 3 % 151, " ".join(t)))
    sets = sets_of(rows, 5)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == grouped(sets)


def test_near_duplicates_in_small_buckets_take_two_rounds(spark, monkeypatch):
    """Families of at most eight: what the first round leaves open is done in one more, without drawing centers, and links found are contracted once."""
    rng = random.Random(11)
    rows = []
    for f in range(40):
        base = [f"f{f}w{i}" for i in range(120)]
        for k in range(rng.randrange(3, 9)):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows) * 7 % 521, " ".join(t)))
    held, plain = {}, common.stored

    def counted(df, name):
        out = plain(df, name)
        held.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(common, "stored", counted)
    monkeypatch.setattr(neardup, "stored", counted)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == grouped(sets_of(rows, 5))
    assert held["rest"][0] and any(held["members"][1:])  # a second round was needed
    assert len(held["marked"]) == len(held["rest"]) == 1 and "parts" not in held
    assert held["links"][-1] < held["links"][0]


def test_near_duplicates_odd(spark):
    got = neardup.near_duplicates(odd_docs(spark)).select("doc_id", "component_id", "kept").collect()
    assert len(got) == 11
    by = {r["doc_id"]: (r["component_id"], r["kept"]) for r in got}
    assert by == {None: (None, True), 1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (4, False), 7: (7, True), 8: (8, True), 9: (9, True)}
    assert neardup.near_duplicates(empty(spark)).collect() == []


def test_shingle_set_is_that_of_words():
    rng = random.Random(1)
    text = pd_series([" ".join(rng.choice("ABab cC") for _ in range(400)), "One  two", "", None, "a b c d e a b c d e a b c d e"])
    for words_, t in zip(neardup.word_hashes(text), text):
        w = lowered(t)
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(neardup.shingle_set(words_, 5)) == len(want)


def pd_series(x):
    import pandas as pd

    return pd.Series(x, dtype=object)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: c for x, c in up.items() if any(x in e and e[0] != e[1] for e in edges)}


def greedy(pieces, word, longest=None):
    n = at = 0
    longest = longest or max(map(len, pieces))
    while at < len(word):
        k = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        if not k:
            return 1
        at, n = at + k, n + 1
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {bytes(rng.choices(b"abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))}
        a = tokencount.automaton(sorted(pieces))
        ws = [bytes(rng.choices(b"abcd"[: rng.choice((3, 3, 4))], k=rng.randrange(1, 15))) for _ in range(40)]
        assert tokencount.count_pieces(a, ws).tolist() == [greedy(pieces, w) for w in ws]
    assert tokencount.count_pieces(tokencount.automaton([]), [b"a"]).tolist() == [1]


def test_token_counts(spark):
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    pieces = set(tokencount.vocabulary(spark, path))
    longest = max(map(len, pieces))
    for docs in (common.table(spark, SF, "documents"), odd_docs(spark)):
        have = docs.select("doc_id", "text").collect()
        want = Counter((d, len(w), sum(greedy(pieces, b" " + x.encode(), longest) for x in w)) for d, t in have for w in [words(t)])
        assert Counter(map(tuple, tokencount.token_counts(docs, path).collect())) == want
    assert tokencount.token_counts(empty(spark), path).collect() == []


def test_all_segmentations_are_summed():
    pieces = language.Pieces(["▁a", "▁", "a", "b", "ab", "▁ab", "ba", "<s>", "1"], 10)
    p = np.zeros(pieces.unknown + 1)
    rng = np.random.default_rng(0)
    p[: pieces.none] = rng.dirichlet(np.ones(pieces.none))
    p[pieces.unknown] = language.UNKNOWN

    def brute(w):
        if not w:
            return 1.0
        out = sum(p[pieces.ids[w[:k]]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces.ids)
        return out + (language.UNKNOWN * brute(w[1:]) if w[0] not in pieces.ids else 0)

    model = language.Model(["x"], pieces, p[:, None])
    ws = ["a", "b", "abab", "aaabba", "ca", "bc"]
    assert model.word_scores(ws)[:, 0] == pytest.approx([np.log(brute("▁" + w)) for w in ws])
    learned = language.learn_pieces(pieces, ws[:4], np.ones(4), language.Fit())
    assert learned[: pieces.none].sum() == pytest.approx(1)


def test_language(spark):
    got = {r["doc_id"]: r for r in queries.op5_language(spark, MEDIUM).collect()}
    docs = common.table(spark, MEDIUM, "documents").select("doc_id", "lang").collect()
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs if got[r["doc_id"]]["held_out"]]
    assert np.mean(right) > 0.97


def test_language_odd(spark):
    model = language.learn(common.table(spark, SF, "documents"), f"{queries.TOKENIZERS}/piece_bpe_32k.model", common.held_out(4, 2))
    rows = language.identified(odd_docs(spark), model).collect()
    assert len(rows) == 11 and all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) and 0 <= r["score"] <= 1 for r in rows)
    nothing = language.learn(empty(spark), f"{queries.TOKENIZERS}/piece_bpe_32k.model", common.held_out(4, 2))
    assert {r["lang_pred"] for r in language.identified(odd_docs(spark), nothing).collect()} == {"und"}


def held_out_auc(got, labels, column, k, remainder):
    rows = [(got[r["doc_id"]]["score"], r[column]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % k == remainder]
    one, none = ([s for s, y in rows if y == want] for want in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in one for b in none])


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, sf).collect()}
    labels = common.table(spark, sf, "labels").collect()
    assert held_out_auc(got, labels, "quality", 4, 2) > 0.97
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in labels if got[r["doc_id"]]["held_out"]]
    assert np.mean(right) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf).collect()}
    assert len(got) == 10_000 and all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    assert held_out_auc(got, common.table(spark, sf, "labels").collect(), "toxic", 5, 0) > 0.75


def test_windows_are_the_whole_text():
    for t in ("", "a", "Word " * 100, "x" * 1000, "é ñ\n" * 77):
        assert b"".join(toxicity.windows(t, 60)) == (b" " + t.encode().lower() if t else b"")


def test_pair_model_learns_an_interaction():
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    m = quality.fit_model(x, y, np.ones(len(y)), quality.Fit(rounds=20))
    assert np.mean((m.score(x) > 0.5) == y) > 0.95 and m.pairs[0][:2] == (0, 1)


@pytest.mark.parametrize("judge", [quality.judged, toxicity.judged])
def test_classifiers_odd(spark, judge):
    labels = common.table(spark, SF, "labels").withColumn("text", F.lit("clash"))
    none = spark.createDataFrame([(None, None, None), (4, None, None)], "doc_id bigint, quality int, toxic int")
    for docs, known, n in ((odd_docs(spark), labels, 11), (odd_docs(spark), none, 11), (odd_docs(spark), labels.limit(0), 11), (empty(spark), labels, 0), (common.table(spark, SF, "documents"), labels.where("quality = 1 AND toxic = 0"), 200)):
        rows = judge(docs, known).collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)


def test_pipeline(spark):
    """Each stage against plain Python over what the stage before has left."""
    docs = common.table(spark, MEDIUM, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "mixing to target weights", "sharding"]
    kept = {"documents": docs}
    for name, stage in steps.items():
        docs = common.stored(stage(spark, docs, MEDIUM), "stage")
        kept[name] = docs
        if name != "sharding":
            assert docs.columns == kept["documents"].columns
    rows = {n: [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] for n, d in kept.items() if n != "sharding"}
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, MEDIUM, "labels").collect()}
    good = {d for d, _ in rows["quality classifier"]}
    assert np.mean([(d in good) == y for d, y in labels.items()]) > 0.95
    want = grouped(sets_of(rows["quality classifier"], 5))
    assert sorted(d for d, _ in rows["near-duplicates"]) == sorted(d for d, c in want.items() if d == c)
    items = [s for r in common.table(spark, MEDIUM, "benchmark").collect() if (s := shingled(r["text"]))]
    clean = [d for d, t in rows["near-duplicates"] for s in [shingled(t)] if not any(len(i & s) * 100 >= 80 * len(i) for i in items)]
    assert sorted(d for d, _ in rows["benchmark decontamination"]) == sorted(clean)
    epochs = {r["doc_id"]: r["epochs"] for r in mixing.mix(kept["benchmark decontamination"]).collect()}
    assert Counter(d for d, _ in rows["mixing to target weights"]) == Counter({d: n for d, n in epochs.items() if n})
    last = kept["sharding"].collect()
    assert Counter(r["doc_id"] for r in last) == Counter(d for d, _ in rows["mixing to target weights"])


def test_pipeline_odd(spark, tmp_path):
    rows = [(None, "one two three four five six", "en", "a", 1), (1, None, "en", None, 1), (2, "", None, "a", 1), (3, "same words here again and again", "en", "b", 1), (3, "same words here again and again", "en", "b", 1)]
    common.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    common.table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []  # without labels no document is accepted
    for docs in (spark.createDataFrame(rows, DOCS), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.count() <= 6
