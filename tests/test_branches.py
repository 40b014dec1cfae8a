"""Each branch of the row rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from albumloom.functions import geo, names, replies, rules, secrets, times
from albumloom.operators import duplicates
from albumloom.sources import lists


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_folder_dates(spark):
    cases = {
        "2003-07-15北京": "2003-07-15", "2003-0715旅游": "2003-07-15", "2003-07暑假": "2003-07-01", "2003暑假": "2003-01-01", "14-08-15": "2014-08-15", "14-0815": "2014-08-15",
        "69-08": "1969-08-01", "68-08": "2068-08-01", "2014年08月15日": "2014-08-15", "14年8月5日": "2014-08-05", "2014年8月北京行": "2014-08-01", "14年": "2014-01-01",
        "2014年13月": "2014-01-01", "2003-02-30": "2003-02-01", "2003-13-01": "2003-01-01", "trip": None, "0000-01-01": None, "": None,
    }
    assert one(spark, [(k,) for k in cases], "n string", times.folder_date(F.col("n")).cast("string")) == list(cases.values())


def test_capture_ladder(spark):
    rows = [
        ("/a/x/i.jpg", "i.jpg", "2020:01:02 03:04:05", "2021:01:01 00:00:00", 1_000_000_000), ("/a/x/i.jpg", "i.jpg", None, "2021:01:01 00:00:00", 1_000_000_000),
        ("/a/x/mmexport1600000000123.jpg", "mmexport1600000000123.jpg", "bad", "2021:01:01 00:00:00", 1), ("/a/2003-05/PA036443.JPG", "PA036443.JPG", None, None, 1),
        ("/a/x/P2306443.JPG", "P2306443.JPG", None, None, 1_000_000_000), ("/a/2003-05/IMG_20201231_235960.jpg", "IMG_20201231_235960.jpg", None, None, 1),
        ("/a/2003-05/x_5958-12-25.jpg", "x_5958-12-25.jpg", None, None, 1), ("/a/x/y.jpg", "y.jpg", None, None, 1_000_000_000), ("/a/x/y.jpg", "y.jpg", None, None, 5),
    ]
    want = [("metadata", True), ("metadata", True), ("chat_export", True), ("letter_name", False), ("mtime", False), ("folder", False), ("folder", False), ("mtime", False), ("none", False)]
    got = one(spark, rows, "p string, f string, o string, m string, t bigint", times.capture_time(F.col("p"), F.col("f"), F.col("o"), F.col("m"), F.col("t"), F.lit(2024)))
    assert [(g.origin, g.is_exact) for g in got] == want
    assert got[3].t == 1065139200 and got[2].t == 1600000000  # 3 October 2003


def test_names(spark):
    files = ["a.jpg", "a..jpg", ".cshrc", "..jpg", "noext", "x.tar.gz"]
    assert one(spark, [(f,) for f in files], "f string", names.stem(F.col("f"))) == ["a", "a.", ".cshrc", "..jpg", "noext", "x.tar"]
    assert one(spark, [("x.tar.gz",)], "f string", names.add_suffix(F.col("f"), F.lit("_1"))) == ["x.tar_1.gz"]
    pairs = [("img_1", "img_1"), ("img_1", "img_1_s"), ("img_1", "img_12"), ("b", "a"), ("img_1 copy", "img_1")]
    assert one(spark, pairs, "a string, b string", names.variants(F.col("a"), F.col("b"))) == [True, True, False, False, True]


def test_trash(spark):
    rows = [(100, 900, 900), (40000, 300, 900), (40000, 500, 1501), (40000, 500, 1500), (40000, None, 900)]
    got = one(spark, rows, "size_bytes bigint, width int, height int", duplicates.is_trash())
    assert got == ["size_too_small", "resolution_too_low", "extreme_aspect_ratio", None, "unreadable"]
    got = one(spark, rows, "size_bytes bigint, width int, height int", duplicates.is_trash(keep_all=True))
    assert got == [None, None, None, None, "unreadable"]


@pytest.mark.parametrize("url,ok", [("", True), ("https://x", True), ("http://10.0.0.1:80/a", True), ("http://10.999.0.1", False), ("http://172.32.0.1", False), ("http://172.31.0.1", True), ("http://h.example", False), ("ftp://x", False), ("https://", False)])
def test_addresses(spark, url, ok):
    assert (one(spark, [(url,)], "u string", rules.url_problem(F.col("u")))[0] is None) == ok


def test_reply_shapes(spark):
    a, b = '{"photo_id": "a", "is_highlight": true}', '{"photo_id": "b", "is_highlight": false, "reason": "r"}'
    shapes = {
        f"[{a}, {b}]": ["a", "b"], f"```json\n[{a}]\n```": ["a"], f'{{"results": [{a}]}}': ["a"], a: ["a"], f"{a}\n{b}": ["a", "b"], f"{a}{b}": ["a", "b"], f"{a}, {b}": ["a", "b"],
        f"[{a}, {b[:-3]}": ["a"], "[]": [], "none": [], "": [], '[{"event_name": "x"}]': [], f'{{"photos": [{b}]}}': ["b"], '{"photos": ["p"], "event_name": "x"}': [],
        '5 {"event_name": "x"} {"photo_id": "a"}': [], f"5 {a}": ["a"],
    }
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(shapes)], "k string, reply string")
    got = {}
    for r in replies.decision_items(df, ["k"]).collect():
        got.setdefault(int(r["k"]), []).append((r["at"], r["photo_id"]))
    assert [[p for _, p in sorted(got.get(i, []))] for i in range(len(shapes))] == list(shapes.values())


def test_findings(spark):
    text = "key sk-abcdefghijkl1 mail tobe@corp.io me@example.com password='hunter22' secret: \"changeme\" 192.168.1.2.3.4 " + "a1" * 20
    got = one(spark, [("x.txt", text)], "n string, t string", secrets.findings(F.col("n"), F.col("t")))[0]
    assert sorted({(f.level, f.rule) for f in got}) == sorted(
        {("BLOCK", "sk key"), ("WARN", "mail address"), ("BLOCK", "password"), ("WARN", "password placeholder"), ("WARN", "private address"), ("WARN", "long token")}
    )


def test_admin_text(spark):
    rows = [("重庆市", "两江新区", "人和街道"), ("成都市", "锦江区", "春熙路"), ("成都市", "大邑县", ""), ("", "", ""), ("北京市", "北京市", "x")]
    assert one(spark, rows, "c string, d string, t string", geo.admin_text(F.col("c"), F.col("d"), F.col("t"))) == ["重庆市 两江新区 人和街道", "成都市 春熙路", "成都市 大邑县", "", "北京市 x"]


def test_list_edge_cases(spark):
    text = ["IMG_0001.jpg|2456789", "", "invalid_line_without_pipe", "IMG_0007.jpg|not_a_number", "IMG_0008.jpg|4123456|extra", "  IMG_0010.jpg  |  5234567  ", "照片.jpg|7", "|9"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, at int, line string")
    rows = [(r["name"], r["size"], r["mode"]) for r in lists.parsed_list(df).orderBy("at").collect()]
    assert rows == [("IMG_0001.jpg", 2456789, "SIZE"), ("IMG_0007.jpg", -1, "SIZE"), ("IMG_0010.jpg", 5234567, "SIZE"), ("照片.jpg", 7, "SIZE")]
    timed = spark.createDataFrame([("f", 0, "a|1700000000"), ("g", 0, "#MATCH_MODE=SIZE"), ("g", 1, "a|1700000000")], "file string, at int, line string")
    assert {r["file"]: r["mode"] for r in lists.list_modes(timed).collect()} == {"f": "DATETIME", "g": "SIZE"}


def test_name_times_all_reads_every_order(spark, tmp_path):
    """Also names with digits that are no date, and those that are one by chance, as the checking SQL has them."""
    from albumloom.plans import load_all
    from tests.harness import compare, duck

    keys = [*range(1, 40), 19991231, 20240203, 20250101, 20010230, 18991231, 3112311, 120001]
    keys += [k for base in (19991200, 20011200) for k in range(base, base + 40)]
    orders = [(k, f"{1992 + k % 7}-{1 + k % 12:02d}-{1 + k % 28:02d}") for k in sorted(set(keys))]
    df = spark.createDataFrame(orders, "o_orderkey bigint, d string").selectExpr("o_orderkey", "CAST(d AS timestamp_ntz) AS o_orderdate")
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    part = next((tmp_path / "parts").glob("*.parquet"))
    (tmp_path / "orders.parquet").symlink_to(part)
    entry = load_all()["name_times_all"]
    got = {r["o_orderkey"]: r["t"] for r in entry.run(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k, _ in orders}
    odd = {k: t for k, t in got.items() if k % 9 in (7, 8)}
    assert {t is None for t in odd.values()} == {True, False}
    assert compare(spark, duck(str(tmp_path)), entry, str(tmp_path)) is None


def test_batch_document_lists_copies(spark):
    """A group of copies leaves one photo in the batches; the others and the trashed photo are listed and counted."""
    from albumloom.plans.photo_core import document_lists

    def photo(i, name, t, size, hash_lo, width=4000):
        return (i, f"/lib/{i}/{name}", name, t, size, width, 3000, None, None, 7, hash_lo, True)

    rows = [
        photo(1, "a.jpg", 1_000_000, 900_000, 5), photo(2, "a.jpg", 1_000_010, 990_000, 5), photo(3, "a_resized.jpg", 1_000_020, 100_000, 4),
        photo(4, "z.jpg", 1_000_030, 900_000, -1), photo(5, "tiny.jpg", 1_000_040, 900_000, 5, width=300),
    ]
    schema = "photo_id bigint, path string, filename string, t bigint, size_bytes bigint, width int, height int, lat double, lng double, hash_hi bigint, hash_lo bigint, is_exact boolean"
    ph = spark.createDataFrame(rows, schema).withColumn("day", F.to_date(F.lit("1970-01-12")))
    got = document_lists(ph).collect()
    assert {r["file"] for r in got if r["list"] == "batches"} == {"/lib/2/a.jpg", "/lib/4/z.jpg"}
    assert {(r["file"], r["reason"], r["kept_file"]) for r in got if r["list"] == "deduped"} == {
        ("/lib/1/a.jpg", "dup_of:a.jpg", "/lib/2/a.jpg"), ("/lib/3/a_resized.jpg", "dup_of:a.jpg", "/lib/2/a.jpg"),
    }
    assert [(r["file"], r["reason"]) for r in got if r["list"] == "trashed"] == [("/lib/5/tiny.jpg", "resolution_too_low")]
    totals = {r["file"]: r["n"] for r in got if r["list"] == "summary"}
    assert totals == {"total_scanned": 5, "kept": 2, "trashed": 1, "deduped": 2, "batch_count": 1}
