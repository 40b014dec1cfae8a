"""Hash pairs within any distance, and near duplicates built on them, against all pairs."""

import random

import pytest

from albumloom.operators import duplicates, hashindex
from albumloom.params import Chunking
from tests.test_skew import PHOTO, bits, photo


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("radius", [0, 1, 3, 6, 12])
def test_bands_share_out_the_bits(radius):
    for level in range(4):
        masks = hashindex.band_masks(radius, level)
        assert len(masks) == radius + 1 and sum(m & (1 << 64) - 1 for m in masks) == (1 << 64) - 1


@pytest.mark.parametrize("radius, crowd", [(1, 64), (3, 5), (6, 8)])
def test_pairs_within(spark, radius, crowd):
    """Also where a crowd shares whole bands: hashes that differ in few bits alone, of which buckets are dealt again."""
    rng = random.Random(radius)
    dense = {sum(1 << b for b in rng.sample(range(5, 16), rng.randrange(5))) for _ in range(40)}
    wide = {rng.getrandbits(64) for _ in range(40)}
    hashes = {("a", h) for h in dense | wide} | {("b", h ^ 1 << 63) for h in dense} | {(None, h) for h in list(wide)[:5]}
    hashes |= {("a", h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 8)))) for h in wide for _ in range(3)}
    df = spark.createDataFrame([(k, signed(h)) for k, h in hashes], "k string, h bigint")
    got = [tuple(r) for r in hashindex.pairs_within(df, ["k"], radius, crowd).collect()]
    want = {(k, signed(a), signed(b)) for k, a in hashes for j, b in hashes if k == j and a != b and bits(a, b) <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_within_edges(spark):
    assert hashindex.pairs_within(spark.createDataFrame([], "k string, h bigint"), ["k"], 3).collect() == []
    assert hashindex.pairs_within(spark.createDataFrame([("a", 1), ("b", 1)], "k string, h bigint"), ["k"], 0).collect() == []
    with pytest.raises(ValueError):
        hashindex.pairs_within(spark.createDataFrame([], "k string, h bigint"), ["k"], 64)


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_near_duplicates_at_any_distance(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(3)]
    rows = []
    for i in range(120):
        h = rng.choice(base)
        for _ in range(rng.randrange(radius + 2)):
            h ^= 1 << rng.randrange(64)
        name = rng.choice(["IMG_1", "img_1_small", "IMG_12", "IMG_1 copy", "IMG", "IMG_1_small_x", "b"]) + rng.choice([".jpg", ".JPG"])
        rows.append(photo(i, name, None if i % 17 == 0 else h))

    def same(a, b):
        if None in (a[5], b[5]) or bits(a[5], b[5]) + bits(a[6], b[6]) > radius:
            return False
        x, y = sorted((a[3].rsplit(".", 1)[0].lower(), b[3].rsplit(".", 1)[0].lower()), key=len)
        return x == y or (y.startswith(x) and not y[len(x)].isdigit())

    match = {a[0]: {b[0] for b in rows if a is not b and same(a, b)} for a in rows}
    df, p = spark.createDataFrame(rows, PHOTO), Chunking(dup_max_bits=radius)
    got = {r["photo_id"]: (r["first_match"], r["last_match"]) for r in duplicates.duplicate_reach(df, p).collect()}
    assert got == {i: (min(m | {i}), max(m | {i})) for i, m in match.items() if m}
    group = {}
    for i in match:
        todo, seen = [i], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += match[x]
        group[i] = min(seen)
    assert {r["photo_id"]: r["group_id"] for r in duplicates.duplicate_groups(df, p).collect()} == group
