"""Keyed state with event-time timers: uploads from first chunk to removal, and a day's segments as its photos arrive.

Rows are first summed up per key and second in a streaming aggregate. A second comes out of it once the watermark
has passed, so what a key receives later is always later: the aggregate is the buffer that puts late rows in place,
and a busy key sends one row per second, summed up before it is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from albumloom.params import Chunking, Tasks
from albumloom.streaming.runtime import event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The store that keyed state needs, for queries started inside; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def per_second(stream: DataFrame, keys: list[str], delay: str, **aggregates) -> DataFrame:
    """One row per key and second, with ``t`` in whole seconds, once the watermark has passed its end."""
    rows = event_time(stream, delay).groupBy(*keys, F.window("ts", "1 second").alias("w")).agg(*[c.alias(k) for k, c in aggregates.items()])
    return rows.select(*keys, F.unix_seconds("w.start").alias("t"), *aggregates)


@dataclass
class Upload:
    """One upload in whole seconds; ``ended`` is null while it goes on."""

    start: int
    last: int
    chunks: int
    refused: int
    ended: int | None = None

    def deadline(self, p: Tasks) -> tuple[int, str]:
        oldest, idle = self.start + p.max_age_seconds, self.last + p.idle_seconds
        return (oldest, "max_age") if oldest <= idle else (idle, "idle")


STORED = "start bigint, last bigint, chunks bigint, refused bigint, ended bigint"
LIFE = "task_id bigint, start bigint, at bigint, event string, chunks bigint"


def passed(up: Upload | None, now: int, p: Tasks) -> tuple[Upload | None, list[tuple]]:
    """The upload at ``now``, with what has happened by then: (start, at, event, chunks)."""
    out = []
    if up is not None and up.ended is None:
        at, cause = up.deadline(p)
        if now > at:
            up.ended = at
            out.append((up.start, at, cause, up.chunks))
    if up is not None and up.ended is not None and now > up.ended + p.retention_seconds:
        out.append((up.start, up.ended + p.retention_seconds, "dropped", up.refused))
        up = None
    return up, out


def received(up: Upload | None, t: int, n: int, done: bool, p: Tasks) -> tuple[Upload, list[tuple]]:
    """The upload after ``n`` chunks at second ``t``, the last one of which may finish it."""
    up, out = passed(up, t, p)
    if up is None:
        up = Upload(t, t, n, 0)
    elif up.ended is None:
        up.last, up.chunks = t, up.chunks + n
    else:
        up.refused += n
        return up, out
    if done:
        up.ended = t
        out.append((up.start, t, "finished", up.chunks))
    return up, out


class UploadLife(StatefulProcessor):
    """Keeps one upload per task, with one timer at the next thing that time alone brings about."""

    def __init__(self, p: Tasks):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("upload", STORED)

    def _held(self) -> Upload | None:
        got = self.state.get() if self.state.exists() else None
        return Upload(*got) if got is not None else None

    def _keep(self, up: Upload | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if up is None:
            self.state.clear()
            return
        self.state.update(astuple(up))
        due = up.deadline(self.p)[0] if up.ended is None else up.ended + self.p.retention_seconds
        self.handle.registerTimer((due + 1) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        up, out = self._held(), []
        for r in pd.concat(list(rows)).sort_values("t").itertuples(index=False):
            up, said = received(up, int(r.t), int(r.n), bool(r.done), self.p)
            out += said
        self._keep(up)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        up, out = passed(self._held(), timerValues.getCurrentWatermarkInMs() // 1000, self.p)
        self._keep(up)
        yield self._rows(key, out)

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["task_id", "start", "at", "event", "chunks"])

    def close(self) -> None:
        pass


def upload_life(chunks: DataFrame, delay: str, p: Tasks = Tasks()) -> DataFrame:
    """(task_id, ts, done) stream -> task_id, start, at, event, chunks; times in whole seconds.

    An upload begins with its first chunk. It fails as ``idle`` when more than the idle time passes without a chunk, as ``max_age`` when it
    grows older than the age limit, whatever it still receives, and is ``finished`` by a chunk marked done. After the
    retention time it is ``dropped`` and leaves the state; ``chunks`` then counts those refused meanwhile. The next
    chunk begins anew. Failures and drops come from timers where no chunk brings them up first.
    """
    done = F.coalesce(F.bool_or("done"), F.lit(False))
    seconds = per_second(chunks, ["task_id"], delay, n=F.count("*"), done=done)
    return seconds.groupBy("task_id").transformWithStateInPandas(UploadLife(p), LIFE, "Append", "EventTime")


MARKS = "day string, t bigint, n bigint, segment bigint"
CARRIED = "t bigint, tail bigint, segment bigint"


def _signed(h: int) -> int:
    """64 bits as the whole number that a BIGINT holds."""
    return h - (1 << 64) if h >> 63 else h


def _unsigned(h: int) -> int:
    return h & (1 << 64) - 1


class DaySegments(StatefulProcessor):
    """Holds the last second of a day with its last hash, so that the next one is told from it batches later."""

    def __init__(self, p: Chunking, hold_seconds: int):
        self.p, self.hold = p, hold_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", CARRIED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else None
        t, tail, segment = before if before is not None else (None, None, 0)
        out = []
        # hashes come in halves, since a column with nulls arrives as floats
        for r in pd.concat(list(rows)).sort_values("t").itertuples(index=False):
            head, now = (None if pd.isna(hi) or pd.isna(lo) else int(hi) << 32 | int(lo) for hi, lo in ((r.head_hi, r.head_lo), (r.tail_hi, r.tail_lo)))
            gap = None if t is None else int(r.t) - t
            if gap is not None and gap >= self.p.burst_seconds:
                far = tail is not None and head is not None and (_unsigned(tail) ^ head).bit_count() > self.p.segment_max_bits
                segment += gap > self.p.hard_cut_seconds or far
            t, tail = int(r.t), None if now is None else _signed(now)
            out.append((key[0], t, int(r.n), segment))
        self.state.update((t, tail, segment))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((t + self.hold) * 1000)
        yield pd.DataFrame(out, columns=["day", "t", "n", "segment"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["day", "t", "n", "segment"])

    def close(self) -> None:
        pass


def segment_stream(photos: DataFrame, delay: str, p: Chunking = Chunking()) -> DataFrame:
    """(day, ts, photo_id, hash_hi, hash_lo) stream -> day, t, n, segment: the time and hash rule over each day's seconds.

    The same marks as the batch rule gives. A day's state is one second; it goes a day after the last one.
    """
    ends = {f"{end}_{half}": by(f"hash_{half}", "photo_id") for end, by in (("head", F.min_by), ("tail", F.max_by)) for half in ("hi", "lo")}
    seconds = per_second(photos, ["day"], delay, n=F.count("*"), **ends)
    return seconds.groupBy("day").transformWithStateInPandas(DaySegments(p, 86400), MARKS, "Append", "EventTime")
