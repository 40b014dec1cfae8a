"""Operators that spread one key over many tasks, against plain code on small fixtures."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumloom.operators import batches, duplicates, segments
from albumloom.operators.components import components
from albumloom.operators.ordering import in_order, running_max
from albumloom.params import Chunking

DAY = datetime.date(2024, 1, 1)


def bits(a, b):
    return (a ^ b).bit_count()


def test_in_order_on_one_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 5).alias("k"), (F.col("id") * 7919 % 5003).alias("o"), "id")
    got = {r["id"]: r for r in in_order(df, ["k"], ["o", "id"], ["o"]).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r["k"], []).append((r["o"], r["id"]))
    for rows in by.values():
        rows.sort()
        for i, (o, id_) in enumerate(rows):
            assert got[id_]["pos"] == i
            assert got[id_]["prev_o"] == (rows[i - 1][0] if i else None)


def test_running_max_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr("albumloom.operators.ordering.BLOCK", 16)
    values = [random.Random(1).choice([None, i % 37]) for i in range(200)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, pos bigint, v int")
    for inclusive in (True, False):
        got = {r["pos"]: r["m"] for r in running_max(df, ["k"], {"m": F.col("v")}, inclusive).collect()}
        for i in range(200):
            seen = [v for v in values[: i + inclusive] if v is not None]
            assert got[i] == (max(seen) if seen else None)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want


def photo(i, name, h, t=0, size=1):
    return (i, DAY, t, name, size, h & 0xFFFFFFFF if h is not None else None, h >> 32 if h is not None else None, f"/p/{i}/{name}")


PHOTO = "photo_id bigint, day date, t bigint, filename string, size_bytes bigint, hash_lo bigint, hash_hi bigint, path string"


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    rows = []
    for i in range(150):
        h = rng.choice(base)
        for _ in range(rng.randrange(3)):
            h ^= 1 << rng.randrange(64)
        name = rng.choice(["IMG_1", "img_1_small", "IMG_12", "IMG_1 copy", "IMG", "IMG_1_small_x", "b"]) + rng.choice([".jpg", ".JPG"])
        rows.append(photo(i, name, None if i % 17 == 0 else h))

    def same(a, b):
        if None in (a[5], b[5]) or bits(a[5], b[5]) + bits(a[6], b[6]) > 2:
            return False
        x, y = sorted((a[3].rsplit(".", 1)[0].lower(), b[3].rsplit(".", 1)[0].lower()), key=len)
        return x == y or (y.startswith(x) and not y[len(x)].isdigit())

    match = {a[0]: {b[0] for b in rows if a is not b and same(a, b)} for a in rows}
    df = spark.createDataFrame(rows, PHOTO)
    got = {r["photo_id"]: (r["first_match"], r["last_match"]) for r in duplicates.duplicate_reach(df).collect()}
    assert got == {i: (min(m | {i}), max(m | {i})) for i, m in match.items() if m}
    group = {}
    for i in sorted(match):
        todo, seen = [i], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += match[x]
        group[i] = min(seen)
    assert {r["photo_id"]: r["group_id"] for r in duplicates.duplicate_groups(df).collect()} == group


def cut_by_recursion(score, p):
    out = []

    def run(s, e):
        if e - s <= p.max_batch:
            out.append(s)
            return
        best, at = -1, s + (e - s) // 2
        for i in range(s + p.min_side, e - p.min_side + 1):
            if score[i] is not None and score[i] > best:
                best, at = score[i], i
        run(s, at)
        run(at, e)

    run(0, len(score))
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "equal", "few", "null"])
@pytest.mark.parametrize("max_batch", [10, 16])
def test_split_in_rounds_equals_recursion(spark, kind, max_batch):
    p = Chunking(max_batch=max_batch)
    rng = random.Random(kind + str(max_batch))
    n, t, h, rows = 120, 0, 0, []
    for i in range(n):
        t += {"gaps": rng.choice([0, 60, 60, 120])}.get(kind, 1)
        h = {"random": rng.getrandbits(64), "few": rng.choice([0, 0, 0, 3])}.get(kind, 0)
        rows.append(photo(i, f"a{i}.jpg", None if kind == "null" else h, t))
    score = [None] + [None if a[5] is None or b[5] is None else bits(a[5], b[5]) + bits(a[6], b[6]) + min((b[2] - a[2]) / 60, 10) for a, b in zip(rows, rows[1:])]
    starts = cut_by_recursion(score, p)
    want = {i: max(s for s in starts if s <= i) for i in range(n)}
    df = spark.createDataFrame(rows, PHOTO).withColumn("event", F.lit(0).cast("bigint"))
    for local_rows in (10**6, 50):
        got = {r["photo_id"]: r["start"] for r in batches.split_events(df, p, local_rows).collect()}
        assert got == want, (kind, local_rows)


def test_fold_over_blocks(spark):
    p, rng = Chunking(), random.Random(9)
    pieces, t = [], 0
    for i in range(300):
        t += rng.choice([10, 100, 1000])
        pieces.append((DAY, i, 0, rng.choice([1, 1, 2, 3, 5]), t, t + 5))
    want, held, last, no = {}, 0, None, -1
    for _, i, _, n, a, b in pieces:
        if held and held <= 3 and n <= 3 and held + n <= 10 and a - last <= 480:
            held += n
        else:
            held, no = n, no + 1
        last, want[i] = b, no
    df = spark.createDataFrame(pieces, "day date, event bigint, start bigint, size bigint, first_t bigint, last_t bigint")
    for rows in (10**6, 7):
        assert {r["event"]: r["batch_no"] for r in batches.number_batches(df, p, block_rows=rows).collect()} == want


def test_segments_with_a_hot_second(spark):
    rng = random.Random(2)
    rows = [photo(i, f"a{i}.jpg", rng.getrandbits(64) if i % 9 else None, 1000 if i % 3 == 0 else i * 40) for i in range(600)]
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    want, seg = {order[0][0]: 0}, 0
    for a, b in zip(order, order[1:]):
        gap = b[2] - a[2]
        if gap > 1800 or (gap >= 90 and None not in (a[5], b[5]) and bits(a[5], b[5]) + bits(a[6], b[6]) > 22):
            seg += 1
        want[b[0]] = seg
    df = spark.createDataFrame(rows, PHOTO)
    got = df.join(segments.segment_marks(df).select("day", "t", "segment"), ["day", "t"])
    assert {r["photo_id"]: r["segment"] for r in got.collect()} == want


def test_dct_hash_matches_median_rule(spark):
    from albumloom.operators.imagehash import dct_hashes

    rng = np.random.default_rng(0)
    rows = [(i, rng.random(1024).tolist()) for i in range(5)]
    got = {r["photo_id"]: (r["hash_hi"], r["hash_lo"]) for r in dct_hashes(spark.createDataFrame(rows, "photo_id bigint, luma array<double>")).collect()}
    k = np.arange(32)
    basis = np.cos(np.pi * np.outer(np.arange(8), 2 * k + 1) / 64)
    for i, luma in rows:
        low = (basis @ np.array(luma).reshape(32, 32) @ basis.T).ravel()
        on = low > np.median(low)
        assert got[i] == (sum(1 << j for j in range(32) if on[j]), sum(1 << j for j in range(32) if on[32 + j]))
