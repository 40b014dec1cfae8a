"""Turning events into batches: split the oversize ones, join small neighbours, number them per day."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumloom.functions.hashes import hamming
from albumloom.functions.names import add_suffix
from albumloom.operators.duplicates import duplicate_groups, is_trash, keepers
from albumloom.operators.ordering import in_order, running_max
from albumloom.operators.segments import with_events
from albumloom.params import Chunking
from albumloom.session import settle

LOCAL_ROWS = 20_000
FOLD_BLOCK = 20_000
PIECE = ["day", "event", "start"]


def split_score() -> Column:
    """Worth of a cut before this photo: hash distance to the one before plus the gap in minutes, ten at most."""
    bits = hamming(F.col("prev_hash_hi"), F.col("prev_hash_lo"), F.col("hash_hi"), F.col("hash_lo"))
    return bits + F.least((F.col("t") - F.col("prev_t")) / F.lit(60.0), F.lit(10.0))


def _cut_starts(score: np.ndarray, p: Chunking) -> list[int]:
    """First rows of the pieces of one event; ``score[i]`` is the worth of a cut before row i, NaN when unknown."""
    side, todo, starts = p.min_side, [(0, len(score))], []
    worth = np.where(np.isnan(score), -1.0, score)
    while todo:
        s, e = todo.pop()
        if e - s <= p.max_batch:
            starts.append(s)
            continue
        allowed = worth[s + side : e - side + 1]
        at = s + (e - s) // 2
        if allowed.size and allowed.max() > -1.0:
            at = s + side + int(allowed.argmax())
        todo += [(s, at), (at, e)]
    return sorted(starts)


def _split_local(p: Chunking) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        starts = np.asarray(_cut_starts(pdf["score"].to_numpy(dtype=float), p))
        own = starts[np.searchsorted(starts, np.arange(len(pdf)), side="right") - 1]
        return pdf.assign(start=pdf["start"].to_numpy() + own)[["day", "event", "start", "photo_id"]]

    return run


def _split_round(rows: DataFrame, p: Chunking) -> DataFrame:
    """One round over pieces too large for one task: every cut that the recursion is sure to make at the
    piece's best score, all at once. ``start``/``stop`` bound the piece.

    The recursion takes the first best position, then goes on to the right of it with the same best score, so
    among the best-scored positions it keeps the first and then each that lies ``side`` or more after the last
    kept. In a run of neighbouring positions that is every ``side``-th one, as long as no run before it starts
    closer than ``side`` to the best position before. What comes after such a tight start, and positions near
    the end where the remainder may already be small enough, wait for a later round; the first best position is
    always taken. With a side of two no start is tight.
    """
    side = p.min_side
    ok = (F.col("pos") >= F.col("start") + side) & (F.col("pos") <= F.col("stop") - side)
    best = rows.where(ok).groupBy(*PIECE).agg(
        F.max("score").alias("top"), F.min_by("pos", F.struct(-F.col("score"), F.col("pos"))).alias("first_at")
    )
    rows = rows.join(best, PIECE, "left")
    cand = ok & F.col("score").eqNullSafe(F.col("top")) & F.col("top").isNotNull()
    head = cand & ((F.col("pos") == F.col("start") + side) | ~F.col("prev_score").eqNullSafe(F.col("top")))
    rows = rows.withColumn("cand", cand).withColumn("head", head)
    rows = running_max(rows, PIECE, {"run": F.when(F.col("head"), F.col("pos"))})
    rows = running_max(rows, PIECE, {"last_cand": F.when(F.col("cand"), F.col("pos"))}, upto_current=False)
    rows = running_max(rows, PIECE, {"tight": F.when(F.col("head") & (F.col("pos") - F.col("last_cand") < side), F.col("pos"))})
    sure = F.col("cand") & F.col("tight").isNull() & ((F.col("pos") - F.col("run")) % side == 0) & (F.col("pos") < F.col("stop") - p.max_batch)
    middle = F.col("start") + F.floor((F.col("stop") - F.col("start")) / 2)
    cut = F.when(F.col("top").isNull(), F.col("pos") == middle).otherwise(sure | (F.col("pos") == F.col("first_at")))
    rows = running_max(rows, PIECE, {"cut_at": F.when(cut, F.col("pos"))})
    rows = rows.withColumn("start", F.coalesce("cut_at", "start"))
    sizes = rows.groupBy(*PIECE).agg((F.col("start") + F.count("*")).alias("stop"))
    return rows.select("day", "event", "start", "pos", "photo_id", "score", "prev_score").join(sizes, PIECE)


def split_events(photos: DataFrame, p: Chunking = Chunking(), local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Photos (day, event, t, photo_id, hashes) -> (day, event, start, photo_id); ``start`` orders the pieces of an event.

    Events within the batch size pass through. Larger ones are cut in one task each up to ``local_rows``
    photos; beyond that they are cut in rounds of grouped steps until their pieces are small enough.
    """
    cols = ["day", "event", "t", "photo_id", "hash_hi", "hash_lo"]
    sizes = photos.groupBy("day", "event").agg(F.count("*").alias("size"))
    sized = photos.select(*cols).join(sizes, ["day", "event"])
    small = sized.where(F.col("size") <= p.max_batch).select("day", "event", F.lit(0).cast("bigint").alias("start"), "photo_id")
    placed = in_order(sized.where(F.col("size") > p.max_batch), ["day", "event"], ["t", "photo_id"], ["t", "hash_hi", "hash_lo"])
    rows = placed.select(
        "day", "event", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("stop"), "pos", "photo_id", split_score().alias("score")
    )
    done = [small]
    huge = rows.where(F.col("stop") > local_rows)
    if sizes.where(F.col("size") > local_rows).limit(1).count():
        before = placed.select("day", "event", (F.col("pos") + 1).alias("pos"), split_score().alias("prev_score"))
        huge = settle(huge.join(before, ["day", "event", "pos"], "left"))
        while True:
            huge = settle(_split_round(huge, p))
            length = F.col("stop") - F.col("start")
            done.append(huge.where(length <= p.max_batch).select("day", "event", "start", "photo_id"))
            rows = rows.where(F.col("stop") <= local_rows).unionByName(
                huge.where((length > p.max_batch) & (length <= local_rows)).select(*rows.columns)
            ) if len(done) == 2 else rows.unionByName(huge.where((length > p.max_batch) & (length <= local_rows)).select(*rows.columns))
            huge = huge.where(length > local_rows)
            if not huge.limit(1).count():
                break
    local = rows.groupBy(*PIECE).applyInPandas(_split_local(p), "day date, event bigint, start bigint, photo_id bigint")
    for part in done:
        local = local.unionByName(part)
    return local


def _fold(sizes: np.ndarray, near: np.ndarray, entry: int, p: Chunking) -> tuple[int, np.ndarray]:
    """Run the joining rule over neighbours; returns the size of the last open batch and the opening flags."""
    opens = np.ones(len(sizes), dtype=bool)
    held = entry
    for i, (n, close) in enumerate(zip(sizes.tolist(), near.tolist())):
        if close and held and held <= p.small_batch and n <= p.small_batch and held + n <= p.max_batch:
            held += n
            opens[i] = False
        else:
            held = n
    return min(held, p.small_batch + 1), opens


def _fold_maps(p: Chunking) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a block of neighbours does to each possible size of the batch left open before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = [_fold(pdf["size"].to_numpy(), pdf["near"].to_numpy(), s, p) for s in range(p.small_batch + 2)]
        return pd.DataFrame(
            {"day": [pdf["day"].iloc[0]], "block": [pdf["block"].iloc[0]], "leaves": [[o[0] for o in out]], "opened": [[int(o[1].sum()) for o in out]]}
        )

    return run


def _fold_block(p: Chunking) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        _, opens = _fold(pdf["size"].to_numpy(), pdf["near"].to_numpy(), int(pdf["entry"].iloc[0]), p)
        number = pdf["offset"].to_numpy() + np.cumsum(opens) - 1
        return pdf.assign(batch_no=number)[["day", "event", "start", "batch_no"]]

    return run


def number_batches(pieces: DataFrame, p: Chunking = Chunking(), join_small: bool = True, block_rows: int = FOLD_BLOCK) -> DataFrame:
    """Pieces (day, event, start, size, first_t, last_t) -> ``batch_no`` per day after joining small neighbours.

    The rule looks only at the size of the batch left open, one of a handful of values, so a block of
    neighbours is a map from that value to the next. Blocks are summed up in parallel, chained per day over
    one row per block, then run again from their known entry.
    """
    placed = in_order(pieces, ["day"], ["event", "start"], ["last_t"])
    if not join_small:
        return placed.select("day", "event", "start", F.col("pos").alias("batch_no"))
    near = F.coalesce(F.col("first_t") - F.col("prev_last_t") <= p.small_gap_seconds, F.lit(False))
    rows = placed.select("day", "event", "start", "pos", "size", near.alias("near"), F.floor(F.col("pos") / block_rows).alias("block"))
    first = rows.where("block = 0").withColumn("entry", F.lit(0)).withColumn("offset", F.lit(0).cast("bigint"))
    result = "day date, event bigint, start bigint, batch_no bigint"
    if not rows.where("block > 0").limit(1).count():
        return first.groupBy("day", "block").applyInPandas(_fold_block(p), result)
    maps = rows.groupBy("day", "block").applyInPandas(_fold_maps(p), "day date, block bigint, leaves array<int>, opened array<bigint>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, offset, out = 0, 0, []
        for day, block, leaves, opened in pdf.sort_values("block").itertuples(index=False):
            out.append((day, block, entry, offset))
            entry, offset = int(leaves[entry]), offset + int(opened[entry])
        return pd.DataFrame(out, columns=["day", "block", "entry", "offset"])

    entries = maps.groupBy("day").applyInPandas(chain, "day date, block bigint, entry int, offset bigint")
    return rows.join(entries, ["day", "block"]).groupBy("day", "block").applyInPandas(_fold_block(p), result)


def plan_batches(photos: DataFrame, p: Chunking = Chunking(), drop_copies: bool = True, join_small: bool = True, grouped: DataFrame | None = None) -> DataFrame:
    """All steps from photos to batches. What several of the steps read, the kept photos and their events among it,
    is written out once. ``grouped`` are the ``duplicate_groups`` of the photos that are not trash, where they are
    needed elsewhere as well."""
    kept = settle(photos.where(is_trash(p).isNull())) if grouped is None else None
    if drop_copies:
        kept = settle(keepers(duplicate_groups(kept, p) if grouped is None else grouped).drop("group_id"))
    elif grouped is not None:
        kept = grouped.drop("group_id")
    return batch_photos(settle(with_events(kept, p)), p, join_small)


def batch_photos(photos: DataFrame, p: Chunking = Chunking(), join_small: bool = True) -> DataFrame:
    """Photos with events -> the same photos with ``batch_no``, ``batch_id`` and their place in the batch."""
    cut = split_events(photos, p)
    placed = settle(photos.join(cut.select("photo_id", "start"), "photo_id"))
    pieces = placed.groupBy(*PIECE).agg(F.count("*").alias("size"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    numbered = number_batches(pieces, p, join_small)
    return (
        placed.join(numbered, PIECE)
        .withColumn("batch_id", batch_id())
        .withColumn("rank", F.row_number().over(Window.partitionBy("day", "batch_no").orderBy("event", "start", "t", "photo_id")))
        .drop("start")
    )


def batch_id() -> Column:
    """Day and three-digit number."""
    n = F.col("batch_no").cast("string")
    return F.concat(F.col("day").cast("string"), F.lit("_"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))


def in_batch_ids(batched: DataFrame) -> DataFrame:
    """``item_id``: the file name, with #2, #3 ... for repeats inside a batch (at most ``max_batch`` rows each)."""
    again = F.row_number().over(Window.partitionBy("day", "batch_no", "filename").orderBy("rank"))
    return batched.withColumn("again", again).withColumn(
        "item_id", F.when(F.col("again") == 1, F.col("filename")).otherwise(add_suffix(F.col("filename"), F.concat(F.lit("#"), F.col("again").cast("string"))))
    ).drop("again")


def best_splits(photos: DataFrame, p: Chunking = Chunking()) -> DataFrame:
    """Position after which each oversize event is cut first."""
    sizes = photos.groupBy("day", "event").agg(F.count("*").alias("size")).where(F.col("size") > p.max_batch)
    rows = in_order(
        photos.select("day", "event", "t", "photo_id", "hash_hi", "hash_lo").join(sizes, ["day", "event"]),
        ["day", "event"], ["t", "photo_id"], ["t", "hash_hi", "hash_lo"],
    ).withColumn("score", split_score())
    ok = F.col("score").isNotNull() & (F.col("pos") >= p.min_side) & (F.col("pos") <= F.col("size") - p.min_side)
    best = F.min_by("pos", F.when(ok, F.struct(-F.col("score"), F.col("pos"))))
    return rows.groupBy("day", "event", "size").agg(best.alias("at")).select(
        "day", "event", "size", (F.coalesce("at", F.floor(F.col("size") / 2)) - 1).alias("last_left")
    )
