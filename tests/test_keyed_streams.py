"""Uploads and segments in keyed state, over several runs of one checkpoint."""

import datetime
import json

import pytest

from albumloom.params import Tasks
from albumloom.streaming import keyed, runtime

START = datetime.datetime(2024, 1, 1)
SCHEMA = "task_id bigint, ts timestamp_ntz, done boolean"


def minutes(task, at, done=False):
    return task, START + datetime.timedelta(minutes=at), done


def run(spark, tmp_path, parts, p=Tasks()):
    """Rows out and keys in state after each part."""
    held, before = [], spark.conf.get(keyed.PROVIDER)
    with keyed.keyed_state(spark):
        for part in parts:
            spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
            stream = keyed.upload_life(runtime.stream_table(spark, f"{tmp_path}/in"), "10 minutes", p)
            query = runtime.finish(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
            last = json.loads(query.lastProgress.json)
            held.append(next(o["numRowsTotal"] for o in last["stateOperators"] if "transform" in o["operatorName"]))
    assert spark.conf.get(keyed.PROVIDER) == before
    zero = int(START.replace(tzinfo=datetime.timezone.utc).timestamp())
    rows = spark.read.schema(keyed.LIFE).parquet(f"{tmp_path}/out").collect()
    return sorted((r["task_id"], (r["start"] - zero) / 60, (r["at"] - zero) / 60, r["event"], r["chunks"]) for r in rows), held


def test_upload_life(spark, tmp_path):
    """Kept alive by a chunk every 25 minutes, one upload fails at two hours while it goes on; all leave the state."""
    alive = [minutes(1, 25 * k) for k in range(12)]
    idle, done = [minutes(2, 0), minutes(2, 30), minutes(2, 70)], [minutes(3, 0), minutes(3, 5, True), minutes(3, 6)]
    again = [minutes(3, 60 * 24 + 6)]
    first = alive[:4] + idle[:2] + done
    got, held = run(spark, tmp_path, [first, alive[4:] + idle[2:], again, [minutes(9, 60 * 60)]])
    assert got == sorted([
        (1, 0, 120, "max_age", 5), (1, 0, 120 + 1440, "dropped", 7), (2, 0, 60, "idle", 2), (2, 0, 60 + 1440, "dropped", 1),
        (3, 0, 5, "finished", 2), (3, 0, 5 + 1440, "dropped", 1), (3, 1446, 1476, "idle", 1), (3, 1446, 1476 + 1440, "dropped", 0),
    ])
    # the last chunk alone is still to come out of the buffer
    assert held[-1] == 0 and max(held) >= 3


def test_boundaries(spark, tmp_path):
    """A chunk at the very second of a limit still counts; one a second later does not."""
    p = Tasks(idle_seconds=60, max_age_seconds=120, retention_seconds=60)
    rows = [minutes(1, 0), minutes(1, 1), minutes(1, 2), minutes(1, 2 + 1 / 60), minutes(1, 3), minutes(1, 3 + 1 / 60), minutes(2, 0), minutes(2, 1 + 1 / 60), minutes(7, 60)]
    got, _ = run(spark, tmp_path, [rows], p)
    assert [r for r in got if r[0] == 1] == [(1, 0, 2, "max_age", 3), (1, 0, 3, "dropped", 2), (1, 3 + 1 / 60, 4 + 1 / 60, "idle", 1), (1, 3 + 1 / 60, 5 + 1 / 60, "dropped", 0)]
    assert [r[3:] for r in got if r[0] == 2] == [("idle", 1), ("dropped", 1)]


def test_machine_matches_plain_clock():
    """Second by second, the state machine says what a clock that looks every second would."""
    import random

    p = Tasks(idle_seconds=5, max_age_seconds=12, retention_seconds=9)
    for seed in range(200):
        rng = random.Random(seed)
        rows = sorted({rng.randrange(120): (rng.randrange(1, 3), rng.random() < 0.1) for _ in range(rng.randrange(1, 40))}.items())
        up, got = None, []
        for t, (n, done) in rows:
            up, said = keyed.received(up, t, n, done, p)
            got += said
        up, said = keyed.passed(up, 1000, p)
        assert up is None
        got += said
        want, start, at = [], None, dict(rows)
        for now in range(400):
            if start is not None and ended is None:
                if now - start > p.max_age_seconds:
                    ended = start + p.max_age_seconds
                    want.append((start, ended, "max_age", chunks))
                elif now - last > p.idle_seconds:
                    ended = last + p.idle_seconds
                    want.append((start, ended, "idle", chunks))
            if start is not None and ended is not None and now - ended > p.retention_seconds:
                want.append((start, ended + p.retention_seconds, "dropped", refused))
                start = None
            if now in at:
                n, done = at[now]
                if start is None:
                    start, last, chunks, refused, ended = now, now, n, 0, None
                elif ended is None:
                    last, chunks = now, chunks + n
                else:
                    refused, done = refused + n, False
                if done and ended is None:
                    ended = now
                    want.append((start, now, "finished", chunks))
        assert got == want


@pytest.mark.parametrize("bits", [(0, 0), (2**32 - 1, 2**32 - 1), (1 << 31, 5)])
def test_hash_halves(bits):
    whole = bits[0] << 32 | bits[1]
    assert keyed._unsigned(keyed._signed(whole)) == whole and -(2**63) <= keyed._signed(whole) < 2**63
