"""Readers and writers on real files; streams over two runs of one checkpoint; plan shapes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from albumloom.operators import naming
from albumloom.plans import load_all, views
from albumloom.sources import library, lists, sinks
from albumloom.sources.rules import read_rules
from albumloom.streaming import jobs, runtime

SF = "/root/testdata/sf0.001"


def test_library_scan(spark, tmp_path):
    for p in ["a/x.jpg", "a/.hid/y.jpg", "a/@eaDir/z.jpg", "a/magazine-unlock-1.jpg", "a/n.txt", "a/b/P.JPEG"]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"123")
    rows = library.scan_library(spark, f"{tmp_path}/a; {tmp_path}/a/b").collect()
    assert sorted(os.path.relpath(r["path"], tmp_path) for r in rows) == ["a/b/P.JPEG", "a/x.jpg"]
    assert {r["size"] for r in rows} == {3}


def test_scan_below_a_dot_folder(spark, tmp_path):
    for p in (".photos/x.jpg", ".photos/@eaDir/y.jpg", ".photos/in/z.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"123")
    for root in (f"{tmp_path}/.photos", f"{tmp_path}//.photos/", f"file:{tmp_path}/.photos"):
        rows = library.scan_library(spark, root).collect()
        assert sorted(os.path.relpath(r["path"], tmp_path) for r in rows) == [".photos/in/z.png", ".photos/x.jpg"]


@pytest.mark.parametrize("parts", [1, 3, None])
def test_removal_list_round_trip(spark, tmp_path, parts):
    """Every part is read in the mode it was written in, whatever value its first entry has."""
    rows = [("b.jpg", 5), ("a.jpg", -1), ("c.jpg", -1), ("d.jpg", -1), ("e.jpg", 7), ("f.jpg", -1)]
    for n, some in enumerate((rows, [])):
        out = tmp_path / f"l{n}"
        lists.write_removal_list(spark.createDataFrame(some, "name string, epoch bigint"), str(out), parts)
        lines = lists.read_lines(spark, str(out))
        assert {(r["name"], r["value"]) for r in lists.list_entries(lines).collect()} == set(some)
        assert {(r["name"], r["mode"], r["taken_ms"], r["size"]) for r in lists.parsed_list(lines).collect()} == {(k, "DATETIME", max(v * 1000, -1), -1) for k, v in some}
        texts = [t.split() for p in sorted(out.glob("part*")) if (t := p.read_text())]
        assert all(t[0] == "#MATCH_MODE=DATETIME" for t in texts) and texts
        assert [x for t in texts for x in t[1:]] == [f"{k}|{v}" for k, v in sorted(some)]
        if parts == 3 and some:
            assert len(texts) > 1


def test_nested_document(spark, tmp_path):
    photo = {"file": "/a.jpg", "filename": "a.jpg", "datetime": "2024-01-01 00:00:00", "is_exact_time": True, "gps": [1.0, 2.0]}
    (tmp_path / "d.json").write_text(json.dumps({"params": {}, "batches": [{"date": "2024-01-01", "batch_id": "2024-01-01_000", "size": 1, "photos": [photo]}]}, indent=1))
    rows = sinks.read_nested_document(spark, str(tmp_path / "d.json")).collect()
    assert [(r["batch_id"], r["file"], r["gps"]) for r in rows] == [("2024-01-01_000", "/a.jpg", [1.0, 2.0])]


def test_rule_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"_note": "x", "areas": [{"block": True, "bbox": [1, 2, 3, 4]}, {"name": "n", "bbox": [1, 2]}]}))
    rows = read_rules(spark, str(tmp_path / "r.json")).collect()
    assert [(r["ordinal"], r["name"], r["block"], r["lng_max"]) for r in rows] == [(0, None, True, 4.0)]


def test_copy_plan_runs_twice(spark, tmp_path):
    src = []
    for i in range(3):
        p = tmp_path / f"in{i}" / "a.jpg"
        p.parent.mkdir()
        p.write_text(str(i))
        src.append(("f", "a.jpg", str(p)))
    plan = naming.plan_copies(spark.createDataFrame(src, "folder string, name string, src string"))
    for _ in range(2):
        naming.execute_plan(plan, str(tmp_path / "out"))
    assert sorted(p.read_text() for p in (tmp_path / "out" / "f").iterdir()) == ["0", "1", "2"]


def events(spark, rows):
    return spark.createDataFrame(rows, "task_id bigint, chunk_index int, event_id bigint, bytes bigint, s bigint").select(
        "task_id", "chunk_index", "event_id", "bytes", F.lit(4).alias("total_chunks"), F.expr("timestampadd(SECOND, s, timestamp_ntz'2024-01-01 00:00:00')").alias("ts")
    )


def test_ledger_over_two_runs(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "job")
    events(spark, [(1, 0, 1, 6 << 30, 0), (1, 0, 2, 1, 1), (1, 9, 3, 1, 2)]).write.parquet(src)
    ledger = jobs.chunk_ledger(spark, folder)
    ledger.run(runtime.stream_table(spark, src))
    events(spark, [(1, 0, 4, 1, 3), (1, 1, 5, 5 << 30, 4), (1, 2, 6, 4 << 30, 5)]).write.mode("append").parquet(src)
    ledger.run(runtime.stream_table(spark, src))
    assert sorted(r["event_id"] for r in ledger.last().collect()) == [1, 6]  # repeat, range and limit turn the others away
    before = sorted(map(tuple, ledger.last().collect()))
    ledger(spark.read.parquet(src).where("event_id > 3"), 1)  # a batch that runs again
    assert sorted(map(tuple, ledger.last().collect())) == before


def test_uploads_complete_over_two_runs(spark, tmp_path):
    src = str(tmp_path / "in")
    ledger = jobs.completed_uploads(spark, str(tmp_path / "job"))
    events(spark, [(1, 0, 1, 1, 0), (1, 1, 2, 1, 9), (2, 0, 3, 1, 1)]).write.parquet(src)
    ledger.run(runtime.stream_table(spark, src))
    events(spark, [(1, 2, 4, 1, 5), (1, 3, 5, 1, 7), (1, 3, 6, 1, 20)]).write.mode("append").parquet(src)
    ledger.run(runtime.stream_table(spark, src))
    events(spark, [(1, 3, 7, 1, 30)]).write.mode("append").parquet(src)
    ledger.run(runtime.stream_table(spark, src))
    rows = ledger.output("task_id bigint, total_chunks int, ready_at bigint, batch int").collect()
    assert [(r["task_id"], r["total_chunks"], r["ready_at"] // 1000000 % 60) for r in rows] == [(1, 4, 9)]


def test_breaker_carries_over(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "job")
    schema = "run bigint, call_id bigint, t bigint, ok boolean, message string"
    spark.createDataFrame([(1, i, i, False, "odd") for i in range(3)] + [(2, 9, 1, False, "x 401 y")], schema).write.parquet(src)
    ledger = jobs.circuit_breaker(spark, folder)
    ledger.run(runtime.stream_table(spark, src))
    spark.createDataFrame([(1, 10 + i, 10 + i, False, "odd") for i in range(3)], schema).write.mode("append").parquet(src)
    ledger.run(runtime.stream_table(spark, src))
    rows = ledger.output("run bigint, tripped_by bigint, cause string, batch int").collect()
    assert sorted(map(tuple, rows)) == [(1, 11, "failures"), (2, 9, "fatal")]


def test_new_files_once(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    for name in ("a.jpg", "b.jpg"):
        (src / name).write_text("x")
        runtime.finish(jobs.new_files(spark, str(src)), out, mark)
    assert spark.read.parquet(out).count() == 2


def test_late_rows_are_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    for s in (100000, 100100, 0):
        events(spark, [(1, 0, s, 1, s)]).coalesce(1).write.mode("append").parquet(src)
    stream = runtime.event_time(runtime.stream_table(spark, src, files_per_trigger=1).select("ts"), "10 minutes")
    query = runtime.finish(stream.groupBy(F.window("ts", "10 minutes")).count(), str(tmp_path / "out"))
    assert jobs.dropped_late(query) == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["near_duplicate_reach", "similar_segment_pairs", "alias_boxes", "poi_in_radius", "nested_roots", "match_by_time", "hash_cache_lookup", "consensus", "duplicate_keepers"])
def test_no_cross_products(spark, name):
    text = plan(load_all()[name].run(spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    text = plan(views.table(spark, SF, "lineitem").where("l_orderkey BETWEEN 5 AND 9").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_orderkey)" in text
    scan = plan(load_all()["gallery_range"].run(spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_shipdate" in scan
