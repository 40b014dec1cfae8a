"""MinHash near-dedup with tensored banding: table keys are pairs out of two smaller hash collections; links are verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from albumloom.llm.common import pinned, star_links, stored


@dataclass(frozen=True)
class NearDup:
    """A link needs 100 * intersection >= least * union of the sets of ``words``-word shingles.

    ``side`` tables in each of two collections, ``depth`` minhashes per table: 2 * side * depth minhashes make
    side ** 2 tables of 2 * depth minhashes. A pair of likeness J meets with (1 - (1 - J ** depth) ** side) ** 2:
    0.9994 at J = 0.8 and more above. ``growth`` is by how many times more members of a bucket are tried each round;
    buckets of more than ``crowd`` members left after the first round are cut by what tells them from their center.
    """

    words: int = 5
    least: int = 80
    side: int = 8
    depth: int = 2
    growth: int = 8
    crowd: int = 8


#: characters that are held as words at a time
CHUNK = 4_000_000
#: shingles that are hashed at a time
BLOCK = 1 << 15
_ODD = np.random.default_rng(20_261_201).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pd.Series) -> Iterator[np.ndarray]:
    """Per text the 64-bit hashes of its words, A-Z lower-cased; bytes.lower and bytes.split are those of ASCII."""
    at, n = 0, len(texts)
    while at < n:
        held, chars = [], 0
        while at < n and chars < CHUNK:
            t = texts.iloc[at]
            at += 1
            held.append(t.encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else [])
            chars += len(t) if isinstance(t, str) else 0
        flat = np.empty(sum(map(len, held)), dtype=object)
        flat[:] = list(chain.from_iterable(held))
        codes, unique = pd.factorize(flat)
        hashed = pd.util.hash_array(np.asarray(unique, dtype=object), categorize=False)[codes] if len(flat) else np.empty(0, np.uint64)
        yield from np.split(hashed, np.cumsum([len(x) for x in held])[:-1])


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of the whole sequence where it is shorter."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = min(width, n)
    s = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        s += words[i : n - w + 1 + i] * _ODD[i]
    return np.unique(_mixed(s))


def table_keys(shingles: np.ndarray, p: NearDup) -> np.ndarray:
    """side ** 2 keys: table (i, j) pairs table i of the one collection with table j of the other."""
    if not len(shingles):
        return np.empty(0, np.int64)
    m = 2 * p.side * p.depth
    a, b = _ODD[64 : 64 + m, None], _ODD[1024 : 1024 + m, None]
    low = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        low = np.minimum(low, (shingles[None, at : at + BLOCK] * a + b).min(axis=1))
    tables = (_mixed(low).reshape(2, p.side, p.depth) * _ODD[2048 : 2048 + p.depth]).sum(axis=2, dtype=np.uint64)
    u, v = _mixed(tables[0]), _mixed(tables[1] + np.uint64(1))
    number = np.arange(p.side**2, dtype=np.uint64).reshape(p.side, p.side)
    return _mixed(u[:, None] * _ODD[3000] + v[None, :] * _ODD[3001] + number).reshape(-1).view(np.int64)


def _signatures(p: NearDup):
    @pandas_udf("n bigint, same_hi bigint, same_lo bigint, keys array<bigint>")
    def signatures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for words in word_hashes(texts):
                s = shingle_set(words, p.words)
                # two independent sums over positions stand for the word sequence
                place = np.arange(1, len(words) + 1, dtype=np.uint64)
                hi, lo = (_mixed(words * _ODD[k] + place * _ODD[k + 1]).sum(dtype=np.uint64) for k in (3100, 3110))
                rows.append((len(s), np.uint64(hi).astype(np.int64), np.uint64(lo).astype(np.int64), table_keys(s, p)))
            yield pd.DataFrame(rows, columns=["n", "same_hi", "same_lo", "keys"])

    return signatures


def _sets(p: NearDup):
    @pandas_udf("array<bigint>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(w, p.words).view(np.int64) for w in word_hashes(texts)], dtype=object)

    return sets


def _verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(a, b, ca, cb) -> (ca, cb), the components, of those whose full sets are alike enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * least).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _pairs(rows: DataFrame) -> DataFrame:
    """(id, component, center, own) -> distinct (a, b, ca, cb), the larger id first."""
    end = F.struct("id", "component"), F.struct(F.col("center").alias("id"), F.col("own").alias("component"))
    both = rows.select(F.greatest(*end).alias("x"), F.least(*end).alias("y"))
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb")).distinct()


def _moved(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component that ``links`` bring each one's component to."""
    to = links.select(F.col("a").alias("component"), F.col("b").alias("_to"))
    return rows.join(to, "component", "left").withColumn("component", F.coalesce("_to", "component")).drop("_to")


def _narrowed(crowd: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(center, id, component) -> key, id, n, component, probe, target, at, d: smaller buckets that hold each link.

    D is the set of shingles that only one of a text and its center has, ordered (not in the center, hash). For a link
    of x and y at most t = (100 - least) / (100 + least) * (|x| + |y|) shingles lie in one of them alone, and
    |Dx & Dy| = (|Dx| + |Dy| - that) / 2. If none is shared both are linked with the center. Otherwise the first
    shared one stands among the first |Dx| - |Dx & Dy| + 1 of Dx, and so for y. With w = (100 - least) / least * |x|,
    the most that t can be: in the text with the larger D it stands among the first w + 1, in that with the smaller D
    among the first w / 2 + 1. Where y is linked with the center and x is not, it stands among the first
    |Dy| - floor((|Dy| - (|y| - |c|) * (100 - least) / (100 + least)) / 2) of Dy. A link needs a probe and a target. ``at`` is the place, from 0, and ``d`` is |D|: for two texts, what stands
    from the first shared one on in each must be at least |Dx & Dy|.
    """
    texts = sets.select("id", F.col("shingles").alias("sx"))
    middles = sets.select(F.col("id").alias("center"), F.col("shingles").alias("sc"))
    both = crowd.join(texts, "id").join(middles, "center")
    told = both.select(
        "center", "id", "component", F.size("sx").alias("n"), F.size("sc").alias("cn"),
        pinned(F.concat(F.array_except("sx", "sc"), F.array_except("sc", "sx"))).alias("apart"),
    ).withColumn("d", F.size("apart"))
    linked = told.withColumn("linked", F.col("d") * (100 + least) <= (F.col("n") + F.col("cn")) * (100 - least))
    most = F.floor(F.col("n") * (100 - least) / least)
    near = F.col("d") - F.floor((F.col("d") * (100 + least) - (F.col("n") - F.col("cn")) * (100 - least)) / (2 * (100 + least)))
    first = F.slice("apart", 1, F.when(F.col("linked"), near).otherwise(most + 1).cast("int"))
    each = linked.select("center", "id", "n", "component", "linked", "d", most.alias("most"), F.posexplode(first).alias("at", "shingle"))
    probe = F.col("linked") | (F.col("at") <= F.floor(F.col("most") / 2))
    flags = [probe.alias("probe"), (~F.col("linked")).alias("target")]
    return each.select(F.xxhash64("center", "shingle").alias("key"), "id", F.col("n").cast("bigint").alias("n"), "component", *flags, "at", "d")


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets that can still hold a link between components, with the number ``c`` of the bucket's members."""
    flags = [F.max(k).alias(k) for k in ("probe", "target")]
    held = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"), *flags)
    # stored, as a join with a table, unlike one with a grouping on its key, can split a hot bucket
    return members.join(stored(held.where("lo < hi AND probe AND target").select("key", "c"), "open"), "key")


def _drawn(members: DataFrame, step: int, most: int) -> DataFrame:
    """(key, id) of the next centers: in each bucket one of the smallest component and of ``most`` others by hash."""
    parts = stored(members.groupBy("key", "component").agg(F.count("*").alias("c"), F.min("id").alias("id")), "parts")
    held = parts.groupBy("key").agg(F.count("*").alias("parts"), F.min(F.struct("c", "id")).alias("least"))
    drawn = F.pmod(F.xxhash64("key", "component", F.lit(step)), F.col("parts")) < most
    return stored(parts.join(stored(held, "held"), "key").where((F.col("id") == F.col("least.id")) | drawn).select("key", "id"), "centers")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per row.

    Words are what no ASCII white space cuts, A-Z lower-cased. Texts of one word sequence are one class under their
    smallest doc_id; classes that share a table key are candidates. In each bucket every member is held against a
    center, whole sets against whole sets; the first center is the member of the fullest buckets. Buckets that the
    links found have not brought into one component go round again with more centers, those before having left; where
    a bucket has no more members than centers would be tried, each member is one and the bucket is done. Large buckets
    left after the first round are first cut into those of members that differ from the center in a like way; that
    loses no link. A round's links join components, so later rounds contract few links and never those before.
    So every candidate pair is decided, shown to be no link or already connected, and none in one component is tested.

    doc_id identifies a document: all rows with words that repeat one are in one component, and link what their texts
    are like. Texts without words, and nulls, are linked with nothing: such a row stands for its own doc_id. Rows
    without doc_id have no component and are kept. An empty table gives no rows. Other columns are not read.
    """
    signed = stored(docs.select("doc_id", _signatures(p)("text").alias("s")).select("doc_id", "s.*"), "signatures")
    worded = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = stored(worded.groupBy("same_hi", "same_lo").agg(F.min("doc_id").alias("id")), "classes")
    # a document of several texts links the classes of all of them
    word_key = F.struct("same_hi", "same_lo")
    several = worded.groupBy("doc_id").agg(F.min(word_key).alias("lo"), F.max(word_key).alias("hi")).where("lo != hi").select("doc_id")
    also = worded.join(several, "doc_id").join(classes, ["same_hi", "same_lo"]).where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    ids = classes.select("id").distinct()
    rows = worded.join(ids.withColumnRenamed("id", "doc_id"), "doc_id").select(F.col("doc_id").alias("id"), "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("key", "c")
    shared = stored(shared, "shared")  # a join with a table, unlike one with a grouping on its key, can split a hot bucket
    members = stored(rows.join(shared, "key").select("key", "id", "n", "c").distinct(), "members")
    texts = docs.select("doc_id", "text").join(members.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    sets = stored(texts.select(F.col("doc_id").alias("id"), _sets(p)("text").alias("shingles")), "sets")

    # what lies in the fullest buckets is most like the others: the text that copies were edited from
    crowd = members.groupBy("id").agg(F.sum("c").alias("crowd"))
    # a center of several texts may have several sizes in a bucket
    tops = [F.max(F.struct("crowd", (-F.col("id")).alias("id"), (F.col("n") * k).alias("n"))).alias(name) for name, k in (("top", 1), ("low", -1))]
    first = members.join(crowd, "id").groupBy("key").agg(*tops)
    centers = stored(first.select("key", (-F.col("top.id")).alias("center"), F.col("top.n").alias("cn"), (-F.col("low.n")).alias("cn_low")), "centers")
    marked = members.drop("c").join(centers, "key").where("id != center").withColumns({"component": F.col("id"), "own": F.col("center")})
    marked = stored(marked, "marked")
    pairs = marked.where((F.col("n") * 100 >= F.col("cn_low") * p.least) & (F.col("cn") * 100 >= F.col("n") * p.least))
    moves = [star_links(_verified(_pairs(pairs), sets, p.least).unionByName(also))]
    # the centers are decided and leave; what is still in several components goes round again
    plain = {"probe": F.lit(True), "target": F.lit(True), "at": F.lit(0), "d": F.lit(0)}
    rest = stored(_moved(marked.drop("cn", "cn_low", "own"), moves[0]).withColumns(plain), "rest")
    members = stored(_open(rest), "members")
    cut = stored(_narrowed(members.where(F.col("c") > p.crowd).select("center", "id", "component").distinct(), sets, p.least), "narrowed")
    members = stored(members.where(F.col("c") <= p.crowd).drop("center").unionByName(_open(cut)), "members")
    step = 0
    while (largest := members.agg(F.max("c")).first()[0]) is not None:
        step += 1
        most = p.growth**step  # eight times as many each round
        marked = members.where(F.col("c") <= most).withColumn("chosen", F.lit(True))
        if largest > most:
            crowded = members.where(F.col("c") > most)
            drawn = _drawn(crowded, step, most).withColumn("chosen", F.lit(True))
            marked = stored(marked.unionByName(crowded.join(drawn, ["key", "id"], "left")), "marked")
        named = {"id": "center", "n": "cn", "component": "own", "probe": "asks", "target": "answers", "at": "ca", "d": "cd"}
        at = marked.where("chosen").select("key", *[F.col(k).alias(v) for k, v in named.items()])
        # two centers of a bucket meet once
        pairs = marked.join(at, "key").where("component != own AND (probe AND answers OR target AND asks) AND (chosen IS NULL OR id > center)")
        apart = (F.col("n") + F.col("cn")) * (100 - p.least)
        lag = F.greatest(2 * F.col("at") + F.col("cd") - F.col("d"), 2 * F.col("ca") + F.col("d") - F.col("cd"))
        pairs = pairs.where(lag * (100 + p.least) <= apart).where(F.least("n", "cn") * 100 >= F.greatest("n", "cn") * p.least)
        moves.append(star_links(_verified(_pairs(pairs), sets, p.least)))
        if largest <= most:
            break
        rest = stored(_moved(marked.where("chosen IS NULL").drop("chosen", "c"), moves[-1]), "rest")
        members = stored(_open(rest), "members")

    named = classes.withColumnRenamed("id", "component")
    for links in moves:
        named = _moved(named, links)
    # stored, so that the join can split a class that holds many rows
    named = stored(named, "named")
    out = signed.select("doc_id", "n", "same_hi", "same_lo").join(named, ["same_hi", "same_lo"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
