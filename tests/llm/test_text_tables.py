"""Spelling variants, line dedup and whitening against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from albumloom.llm import common, linedup, queries, spelling, whitening
from tests.harness import TABLES, rows
from tests.llm.test_native import empty, odd_docs

SF = "/root/testdata/sf0.001"
SCALE = "/root/testdata/sf0.01"


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# line dedup


def lines_brute(have, least=10):
    key = lambda line: small(line.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for doc, text in have:
        for line in (text or "").split("\n"):
            held[key(line)].add((doc, (text or "") if doc is None else None))
    often = {k for k, d in held.items() if k and len(d) >= least}
    out = []
    for doc, text in have:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in often]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    docs = common.table(spark, SCALE, "documents")
    want = lines_brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(r[2] for r in want)
    assert sorted(map(tuple, linedup.line_dedup(docs).collect()), key=repr) == want


def test_line_dedup_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, cur = queries.op12_line_dedup(spark, SF), con.execute(queries.SQL["op12_line_dedup"])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def line_rows():
    shared = [(i, f"own {i}\n  Shared LINE\t\nend\n\n") for i in range(9)]
    odd = [
        (20, "shared line"), (20, "shared line"), (20, "ÄRGER\nshared line \x0b"), (None, "x\nshared line"), (None, "x\nshared line"), (None, None), (21, ""), (22, None), (23, "ärger\nend"),
        (24, "\n".join(["a"] * 5000 + ["END"] + [f"l{i}" for i in range(5000)])), (25, "x" * 100_000 + "\nshared line"), (26, "  shared line"), (27, "\r\nend\r\n"),
    ]
    return shared + odd


@pytest.mark.parametrize("least", [1, 2, 10, 11, 12, 100])
def test_line_dedup_odd(spark, least):
    """Ties at the threshold, repeated ids and rows, null ids, blank ends, all lines gone, long texts, clashing names."""
    df = spark.createDataFrame(line_rows(), "doc_id bigint, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("hi", "lo", "pos", "key", "mark", "gone", "lines", "kept", "n_lines", "docs", "own", "chars")})
    got = linedup.line_dedup(df, linedup.LineDedup(least_docs=least)).collect()
    assert sorted(map(tuple, got), key=repr) == lines_brute(line_rows(), least)


def test_line_dedup_hot_text(spark):
    """A third of all rows without an id and with one text."""
    have = [(None, "hot\nline")] * 600 + [(i, f"cold {i}\nline") for i in range(1200)]
    got = linedup.line_dedup(spark.createDataFrame(have, "doc_id bigint, text string").repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == lines_brute(have)


def test_line_dedup_empty(spark):
    assert linedup.line_dedup(empty(spark)).collect() == []


# spelling


def edits(word, alphabet):
    cut = [word[:i] + word[i + 1 :] for i in range(len(word))]
    put = [word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet]
    swap = [word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet]
    return {*cut, *put, *swap} - {word}


def variants_brute(have, every=97, least=5, count=3, ratio=2):
    n = Counter()
    for doc, text in have:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = small(run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    alphabet = sorted(set("".join(n)))
    near = {w: [x for x in edits(w, alphabet) if x in n] for w in n}
    form = {}
    for w, held in near.items():
        best = min(held, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spelled(df, p=spelling.Spelling()):
    return sorted(map(tuple, spelling.variants(df, p).collect()), key=repr)


def test_variants(spark):
    docs = common.table(spark, SCALE, "documents")
    want = variants_brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r[1] is not None for r in want) > 5
    assert spelled(docs) == want


@pytest.mark.parametrize("block", [2, 7, 512])
def test_variants_blocks(spark, block):
    """Large buckets in blocks, chains of forms, ties of counts and letters above ASCII."""
    rng = np.random.default_rng(3)
    words = ["aaaaa" + "".join(rng.choice(list("abé"), 4)) for _ in range(300)] + ["stone", "stones", "stonez", "Ärmel", "ärmel", "ÄRMEL", "e" * 300, "e" * 301]
    have = [(i % 50, f"{w}, {w}. {w}! " * (1 + (i * i) % 6)) for i, w in enumerate(words)]
    have += [(100 + k, f"{'chainlinks'[: 5 + k]} " * (3 << k)) for k in range(6)]
    have += [(None, "stone " * 40), (None, None), (7, ""), (8, "x" * 3000 + " " + "x" * 3000), (8, "x" * 3000)]
    df = spark.createDataFrame(have, "doc_id bigint, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("word", "n", "near", "run", "h", "root", "form", "cell", "bucket", "short", "best")})
    want = variants_brute(have)
    assert any(r[1] and r[1] != r[2] for r in want)
    assert spelled(df, spelling.Spelling(block=block, words=64)) == want


def test_variants_odd(spark):
    assert spelled(odd_docs(spark)) == variants_brute([(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()])
    assert spelled(empty(spark)) == []
    assert spelled(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")) == []


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 6).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.text("abcé", min_size=n, max_size=n + 1), min_size=1, max_size=150))))
def test_near_pairs(given_words):
    n, words = given_words[0], sorted(given_words[1])
    i, j = spelling.near_pairs(words, n)
    got = sorted((words[a], words[b]) for a, b in zip(i, j))
    assert got == sorted((a, b) for a in words if len(a) == n for b in edits(a, "abcé") if b in words and len(b) >= n)


# whitening


def whitened_brute(have, most=32):
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in have], dtype=object)
    n, s = len(x), x.sum(axis=0)
    over = n * x - s
    y = (over / n).astype(float)
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    return n, (over**2).sum(axis=1), y @ q / np.sqrt(np.maximum(e, 1e-300)), e / e.sum(), e


def check_whitened(spark, df, have, most=32):
    got = whitening.whitened(df).collect()
    n, deviation, z, share, e = whitened_brute(have)
    k = min(most, int((e > e[0] * len(e) * 1e-14).sum()))
    assert len(got) == len(have) * k
    by = defaultdict(list)
    for r in got:
        assert r["n"] == n and 0 <= r["identity_error"] < 1e-9 and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9
        by[r["component"]].append((str(r["vec_id"]), r["deviation"], r["whitened"]))
    ids = [str(i) for i, _ in have]
    for c, part in by.items():
        want = z[:, c - 1]
        assert sorted(p[:2] for p in part) == sorted(zip(ids, deviation))
        order = sorted(range(len(have)), key=lambda i: (ids[i], deviation[i], abs(want[i])))
        w, g = want[order], np.array([p[2] for p in sorted(part, key=lambda p: (p[0], p[1], abs(p[2])))])
        assert min(np.abs(w - g).max(), np.abs(w + g).max()) < 1e-6
    return got


def test_whitening(spark):
    df = common.table(spark, SF, "embeddings")
    have = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check_whitened(spark, df.repartition(5), have)


def test_whitening_blocks(spark):
    """Several blocks of rows, the last one part full; the scatter matrix does not hang on them."""
    rng = np.random.default_rng(5)
    y = rng.normal(size=(333, 6))
    x = np.floor(y * 1000).astype(np.int64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, x array<bigint>").repartition(4)
    centred = x - x.mean(axis=0)
    for block in (10, 64, 1000):
        made = whitening.centred_blocks(df, x.sum(axis=0).tolist(), 333, block).withColumn("mark", F.monotonically_increasing_id())
        blocks = whitening.numbered(common.stored(made, "blocks").withColumn("rows", F.size("ids")))
        numbers = sorted(r["number"] for r in blocks.collect())
        assert numbers == list(range(len(numbers))) and sorted(i for r in blocks.collect() for i in r["ids"]) == list(range(333))
        got = whitening.scatter(whitening.block_matrix(blocks, "y", 6, block, len(numbers)))
        assert np.allclose(got, centred.T @ centred, rtol=1e-9)


def test_whitening_odd(spark):
    """Null, non-finite, empty and short vectors, null and repeated ids, equal rows, dependent dimensions, clashing names."""
    rng = np.random.default_rng(1)
    good = [(i % 40 if i % 9 else None, [float(a), float(b), float(a + b), 1.0]) for i, (a, b) in enumerate(rng.normal(size=(90, 2)).round(2) * 5)]
    good += good[:5]
    bad = [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0]), (4, [1.0, float("nan"), 2.0, 3.0]), (5, [float("inf"), 0.0, 0.0, 0.0]), (6, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>")
    df = df.withColumns({c: F.lit("clash") for c in ("idx", "c", "x", "y", "z", "n", "dims", "mark", "part", "component", "label")})
    exact = [(i, np.float32(v).astype(float)) for i, v in good]
    got = check_whitened(spark, df, exact)
    assert max(r["component"] for r in got) < 4


def test_whitening_nothing(spark):
    kind = "vec_id bigint, embedding array<float>"
    for have in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whitened(spark.createDataFrame(have, kind))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_registered():
    assert {"op11_spelling_variants", "op12_line_dedup", "op13_whitening"} <= set(queries.QUERIES)
