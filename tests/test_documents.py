"""Documents: large events over several lines, empty ones, report cells with odd texts."""

import pytest

from albumloom.sources import documents
from albumloom.operators import compare


def test_event_lines(spark, tmp_path):
    """A day with a third of all photos in one event, one without any, one that is not merged."""
    days = spark.createDataFrame([("2020-01-01", "merged", "2020-01-01-a", "why"), ("2020-01-02", "merged", "2020-01-02-b", None), ("2020-01-03", "skipped", None, None)], "day string, state string, folder string, reason string")
    events = spark.createDataFrame([("2020-01-01", "2020-01-01-x", 25), ("2020-01-01", "2020-01-01-y", 0), ("2020-01-02", "2020-01-02-z", 1), ("2020-01-03", "2020-01-03-q", 4)], "day string, tag string, photo_count bigint")
    plan = [("2020-01-01", "2020-01-01-x", f"/s/{i:02}.jpg", f"{i}.jpg") for i in range(25)] + [("2020-01-02", "2020-01-02-z", "/s/z.jpg", 'a "b"\n,c.jpg')]
    lines = documents.day_documents(days, spark.createDataFrame(plan, "day string, tag string, src string, final_name string"), events, "/in", per_line=10)
    documents.write_manifests(lines, "date", str(tmp_path / "m"))
    got = sorted(tuple(r) for r in documents.read_manifests(spark, str(tmp_path / "m"), documents.DAY_SCHEMA).collect())
    names = [f"{i}.jpg" for i in range(25)]
    want = [("2020-01-01", "2020-01-01-a", "why", "2020-01-01-x", "/in/2020-01-01-x", 25, 25, k, names[10 * k : 10 * k + 10]) for k in range(3)]
    want += [("2020-01-01", "2020-01-01-a", "why", "2020-01-01-y", "/in/2020-01-01-y", 0, 0, 0, []), ("2020-01-02", "2020-01-02-b", None, "2020-01-02-z", "/in/2020-01-02-z", 1, 1, 0, ['a "b"\n,c.jpg'])]
    assert got == want
    assert (tmp_path / "m" / "date=2020-01-01").is_dir()


def test_nothing_ungrouped(spark, tmp_path):
    """Every event in a theme, and no event at all: a list without a header row, an index of zeros."""
    rest = spark.createDataFrame([], "tag string, year string, photo_count bigint")
    listed = documents.ungrouped_list(rest, "/in")
    assert listed["header"].count() == 0 and listed["events"].count() == 0
    valid = spark.createDataFrame([], "theme string, theme_folder string, events bigint, photos bigint, years array<string>")
    documents.write_document(documents.yearly_index(valid, rest, rest, "/in", "/out"), str(tmp_path / "i"))
    got = documents.read_document(spark, str(tmp_path / "i"), {"header": documents.INDEX_HEADER, "themes": documents.THEME_ROW})
    assert [tuple(r) for r in got["header"].collect()] == [("/in", "/out", 0, 0, 0)] and got["themes"].count() == 0


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    odd = 'first "line"\n second, 好看 好看'
    told = spark.createDataFrame(
        [("a.x", "p1", "keep", odd, "e1"), ("b#2", "p1", "delete", "模糊", ""), ("c`d", "p1", "delete", "模糊", ""), ("a.x", "p2", "keep", " r ", "e"), ("b#2", "p2", "delete", "", ""), ("a.x", "p3", "keep", "x", "e"), ("b#2", "p3", "keep", "x", "e")],
        "run_key string, photo_id string, decision string, reason string, event_tag string",
    )
    runs = spark.createDataFrame([("a.x", "p", "m", "A", 5), ("b#2", None, None, None, None), ("c`d", "p", "m", "A", 0)], "run_key string, provider string, model string, extraction_level string, token_total bigint")
    names = ["a.x", "b#2", "c`d"]
    words = compare.word_counts(told.withColumnRenamed("run_key", "model"), compare.chinese_tokens(told["reason"]))
    out = str(tmp_path_factory.mktemp("report"))
    documents.write_report(documents.report_sheets(told, runs, documents.compared_in_full(told, names), names, words), out)
    return {name: [r.asDict() for r in df.collect()] for name, df in documents.read_report(spark, out).items()}, odd


def test_report_cells(report):
    """Texts with quotes, commas, line breaks and outer blanks come back; run keys may hold any sign."""
    sheets, odd = report
    full = {r["photo_id"]: r for r in sheets["完整对比"]}
    assert full["p1"]["a.x_reason"] == odd and full["p2"]["a.x_reason"] == " r " and full["p2"]["b#2_reason"] == ""
    assert full["p2"]["c`d_decision"] == "MISSING" and full["p2"]["c`d_reason"] == documents.NO_REASON and full["p3"]["consensus"] == "一致"
    assert [r["photo_id"] for r in sheets["差异照片"]] == ["p1", "p2"]


def test_report_counts(report):
    """Kept by one alone asks that all others have deleted the photo; p2 was not judged by the third run."""
    sheets, _ = report
    assert {r["类别"]: (r["数量"], r["占比%"]) for r in sheets["差异统计"]} == {"一致": ("1", "33.3"), "不一致": ("2", "66.7"), "仅a.x保留": ("1", "33.3")}
    stats = {r["运行"]: r for r in sheets["统计汇总"]}
    assert [stats["a.x"][c] for c in ("输入总数", "保留", "删除", "保留率%", "Token消耗")] == ["3", "3", "0", "100.0", "5"]
    assert [stats["b#2"][c] for c in ("模型", "Provider", "档位", "Token消耗")] == ["Unknown", "Unknown", "Unknown", "0"]
    words = {r["模型"]: r for r in sheets["关键词分析"]}
    assert words["a.x"]["保留理由高频词TOP5"] == "好看(2)" and words["a.x"]["删除理由高频词TOP5"] == "" and words["b#2"]["删除理由总词数"] == "1"
