"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under capacity quotas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumloom.llm.common import spread_sums, stored


@dataclass(frozen=True)
class Shards:
    """``slack`` is how far sizes may be apart before linked documents are moved for evenness, in ``passes`` finer and finer."""

    count: int = 16
    rounds: int = 4
    slack: float = 0.02
    passes: int = 3
    seed: int = 11


def shard(docs: DataFrame, p: Shards = Shards()) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, shard, slot; sizes (UTF-8 bytes plus 1) are near equal by shard.

    Links join every document with the text it shares, so neighbours are reached over one row per text and shard and
    no pairs are listed. Documents start at a hash; in each round those of a linked text prefer the shard that holds
    most of it. Moves from shard a to b are let in, in hash order, up to what moves from b to a and b's share of room.
    Texts of more than a shard's capacity spread over several. At the end documents without links, and only where these do not
    suffice others, move from shards above the even share to those below.

    Null texts have size 1, no checksum and no links; empty texts are equal texts. Ids may repeat or be null. Slots
    number a shard's rows from 0. Other columns are not read; an empty table gives no rows.
    """
    nodes = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("hub"),
        F.xxhash64(F.lit(p.seed), F.col("doc_id"), F.col("text")).alias("key"),
    ).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(p.count)).cast("int"))
    nodes = stored(nodes, "nodes")
    hubs = nodes.where("hub != ''").groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub", F.lit(True).alias("linked"))
    hubs = stored(hubs, "hubs")  # a join with a table, unlike one with a grouping on its key, can split a hot text
    nodes = stored(nodes.join(hubs, "hub", "left").withColumn("linked", F.col("linked").isNotNull()), "nodes")
    alone, linked = nodes.where("NOT linked"), nodes.where("linked")
    share = nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] / p.count
    for _ in range(p.rounds):
        linked = _moved(linked, share, p)
    placed = _evened(alone.unionByName(linked), p)
    ranked = spread_sums(placed, ["shard"], "key", ["doc_id", "hub"], {"slot": F.lit(1).cast("bigint")})
    return ranked.select("doc_id", "size", "text_crc32", "shard", "slot")


def _loads(rows: DataFrame, p: Shards) -> list[int]:
    """Bytes by shard, one number each."""
    held = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    return [held.get(s, 0) for s in range(p.count)]


def _moved(linked: DataFrame, share: float, p: Shards) -> DataFrame:
    """One round: every linked row wishes itself to the shard that holds most of its text; quotas decide.

    Linked rows may fill a shard up to its even share, as rows without links make room at the end.
    """
    weights = linked.groupBy("hub", "shard").agg(F.sum("size").alias("w"))
    # ties go by a hash that differs from text to text, so that no shard is the favourite of all
    best = weights.groupBy("hub").agg(F.max(F.struct("w", F.xxhash64("hub", "shard").alias("h"), "shard")).alias("best"))
    best = stored(best.select("hub", F.col("best.shard").alias("to")), "best")
    wish = stored(linked.join(best, "hub"), "wishes")

    loads = _loads(wish, p)
    flow = {(r["shard"], r["to"]): r["b"] for r in wish.where("shard != to").groupBy("shard", "to").agg(F.sum("size").alias("b")).collect()}
    quotas = []
    for to in range(p.count):
        swap = {a: min(flow.get((a, to), 0), flow.get((to, a), 0)) for a in range(p.count)}
        more = {a: flow.get((a, to), 0) - swap[a] for a in range(p.count)}
        free = max(0.0, share - loads[to]) / max(1, sum(more.values()))
        quotas += [float(swap[a] + more[a] * min(1.0, free)) for a in range(p.count)]
    quota = F.element_at(F.array(*map(F.lit, quotas)), F.col("to") * p.count + F.col("shard") + 1)
    movers = spread_sums(wish.where("shard != to"), ["shard", "to"], "key", ["doc_id", "hub"], {"before": F.col("size")})
    movers = movers.withColumn("shard", F.when(F.col("before") + F.col("size") <= quota, F.col("to")).otherwise(F.col("shard")))
    return stored(wish.where("shard = to").drop("to").unionByName(movers.drop("to", "before")), "linked")


def _evened(placed: DataFrame, p: Shards) -> DataFrame:
    """Rows of shards above the even share, laid on one line, fill the gaps of those below; finer rows each pass."""
    placed = stored(placed, "placed")
    loads = _loads(placed, p)
    even = sum(loads) / p.count
    for step in range(2 * p.passes):
        over = max(abs(x - even) for x in loads)
        if step >= p.passes and over <= even * p.slack / 2:
            break
        surplus, lack = ([max(0.0, sign * (x - even)) for x in loads] for sign in (1, -1))
        line = lambda xs: [sum(xs[:i]) for i in range(len(xs))]
        fine = F.col("size") * 4 <= over
        fine = fine if step >= p.passes else fine & ~F.col("linked")
        of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("shard") + 1)
        fine = F.coalesce(fine & (of(surplus) > 0), F.lit(False))
        middle = F.col("before") + F.col("size") / 2
        spot = of([float(x) for x in line(surplus)]) + middle
        to = F.size(F.filter(F.array(*[F.lit(float(x)) for x in line(lack)[1:] + [even * p.count * 2]]), lambda x: x <= spot))
        movers = spread_sums(placed.where(fine), ["shard"], "key", ["doc_id", "hub"], {"before": F.col("size")})
        movers = movers.withColumn("shard", F.when(middle <= of(surplus), to).otherwise(F.col("shard")).cast("int")).drop("before")
        placed = stored(placed.where(~fine).unionByName(movers), "placed")
        loads = _loads(placed, p)
    return placed
