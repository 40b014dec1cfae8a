"""Photo-library shaped views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.functions.hashes import median_bits
from albumloom.functions.names import add_suffix
from albumloom.functions.replies import held
from albumloom.functions.times import seconds_of
from albumloom.session import settle

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_seconds(ts: str) -> Column:
    return seconds_of(F.col(ts))


def json_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def photos(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event seen as a photo; groups of four share a hash and a name stem."""
    vectors = table(spark, sf, "embeddings")
    slots = vectors.agg(F.count("*").alias("n")).scalar()
    hashes = vectors.select(F.col("vec_id").alias("slot"), median_bits(F.col("embedding")).alias("h")).select("slot", "h.*")
    shot = F.expr("event_id div 4")
    suffix = F.element_at(F.array(F.lit(""), F.lit("_resized"), F.lit("_1"), F.lit(" copy")), (F.col("event_id") % 4 + 1).cast("int"))
    base = table(spark, sf, "events").withColumn("k", json_k()).drop("props").select(
        F.col("event_id").alias("photo_id"),
        F.col("user_id").alias("owner"),
        epoch_seconds("ts").alias("t"),
        F.col("ts").cast("date").alias("day"),
        F.concat(F.lit("IMG_"), shot, suffix, F.lit(".jpg")).alias("filename"),
        (F.col("event_id") % 5 != 0).alias("is_exact"),
        (F.floor(F.col("value") * 1000) * (1 + F.col("event_id") % 3)).alias("size_bytes"),
        (200 + 40 * F.col("k")).alias("width"),
        (300 + 60 * (F.col("event_id") % 50)).cast("int").alias("height"),
        F.when(F.col("event_id") % 13 != 0, F.round(29.5 + (F.col("user_id") % 20) * 0.0031, 6)).alias("lat"),
        F.when(F.col("event_id") % 13 != 0, F.round(106.5 + (F.col("k") % 25) * 0.0027, 6)).alias("lng"),
        F.when(F.col("event_id") % 97 != 0, shot % slots).alias("slot"),
    )
    return (
        base.join(hashes, "slot", "left")
        .withColumn("path", F.concat(F.lit("/library/u"), "owner", F.lit("/"), F.col("day").cast("string"), F.lit("/"), "filename"))
        .drop("slot")
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return calls_of(table(spark, sf, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    """One row per event seen as a model call, table or stream."""
    tier = (
        F.when(F.col("event_type").isin("view", "error"), "T1")
        .when(F.col("event_type").isin("click", "signup"), "T2")
        .otherwise("T3")
    )
    message = F.element_at(
        F.array(
            F.lit("Error code: 429 - Too Many Requests"),
            F.lit("HTTP 503 Service Unavailable"),
            F.lit("Insufficient balance: Payment Required"),
            F.lit("Connection reset by peer"),
            F.lit("unexpected token in reply"),
            F.lit("status 401 unauthorized"),
        ),
        (json_k() % 6 + 1),
    )
    tokens = F.floor(F.col("value") * 10).cast("bigint")
    return events.select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("run"),
        epoch_seconds("ts").alias("t"),
        tier.alias("tier"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", message).alias("message"),
        tokens.alias("prompt_tokens"),
        (json_k() * 20).cast("bigint").alias("cached_tokens"),
        (json_k() + 5).cast("bigint").alias("output_tokens"),
    )


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Four models' verdicts on the labelled documents, long form; no model but the first has seen them all."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    labelled = table(spark, sf, "labels").join(docs, "doc_id")
    day = F.format_string("2024-02-%02d", (F.col("doc_id") % 28 + 1))
    both = labelled.select(
        "doc_id",
        F.concat(F.lit("DOC_"), F.col("doc_id"), F.lit(".jpg")).alias("photo_id"),
        F.explode(F.array(*[F.lit(m) for m in "ABCD"])).alias("model"),
        "quality",
        "toxic",
        day.alias("day"),
        "source",
    )
    m, i = F.col("model"), F.col("doc_id")
    both = both.where(F.when(m == "B", i % 11 != 0).when(m == "C", i % 13 != 0).when(m == "D", i % 7 != 0).otherwise(True))
    good, mild = F.col("quality") == 1, F.col("toxic") == 0
    keep = F.when(m == "A", good).when(m == "B", good & mild).when(m == "C", mild).otherwise(i % 3 == 0)
    return both.select(
        "doc_id",
        "photo_id",
        "model",
        F.when(keep, "keep").otherwise("delete").alias("decision"),
        F.when(keep, F.concat("day", F.lit("-"), "source")).otherwise("").alias("event_tag"),
        F.concat(
            F.when(keep, F.lit("构图清晰，来源")).otherwise(F.lit("画面模糊，来源")),
            "source",
            F.when(F.col("doc_id") % 3 == 0, F.lit("，人物自然")).otherwise(F.lit("，背景杂乱")),
        ).alias("reason"),
        "day",
    )


def event_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Event folders: one per market segment, order day and priority; photo_count photos each."""
    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp"))
    name = F.substring("o_orderpriority", 3, 20)
    return (
        orders.join(customers, "o_custkey")
        .groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day"), name.alias("event_name"), "grp")
        .agg(F.count("*").alias("photo_count"))
        .select(
            F.concat("day", F.lit("-"), "event_name").alias("folder"),
            "grp",
            "day",
            F.substring("day", 1, 4).alias("year"),
            "event_name",
            "photo_count",
        )
    )


def events_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Flat layout: one event per folder name, groups united."""
    return event_dirs(spark, sf).groupBy("folder", "day", "year", "event_name").agg(F.sum("photo_count").alias("photo_count")).withColumnRenamed("folder", "tag")


def event_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files below the event folders, one per order, plus manifests and stray names."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    folder = F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("-"), F.substring("o_orderpriority", 3, 20))
    stray = F.when(F.col("o_orderkey") % 41 == 0, F.lit("misc")).when(F.col("o_orderkey") % 43 == 0, F.lit("_FAILED_FOR_MANUAL_REVIEW")).otherwise(folder)
    name = F.when(F.col("o_orderkey") % 19 == 0, F.concat(F.lit("note_"), "o_orderkey", F.lit(".txt"))).otherwise(F.concat(F.lit("IMG_"), F.col("o_custkey") % 50, F.lit(".JPG")))
    sub = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("raw"), F.col("o_orderkey") % 7, F.lit("/"))).otherwise("")
    return o.select(
        "o_orderkey",
        F.concat(
            F.lit("/archive/"), stray, F.lit("/"),
            F.when(F.col("o_orderkey") % 17 == 0, F.lit("manifest.json")).otherwise(F.concat(sub, F.lit("s"), "o_orderkey", F.lit("/"), name)),
        ).alias("path"),
    )


def themes(spark: SparkSession, sf: str) -> DataFrame:
    """First-pass theme of every flat event: by name, every seventh day under a second name, days 31 alone."""
    e = events_by_tag(spark, sf)
    label = F.when(F.dayofmonth(F.col("day").cast("date")) % 7 == 0, F.concat("event_name", F.lit("记录"))).otherwise(F.concat("event_name", F.lit("主题")))
    label = F.when(F.dayofmonth(F.col("day").cast("date")) == 31, F.concat(F.lit("单次"), "tag")).otherwise(label)
    return e.select(label.alias("theme"), "tag", "year", "photo_count")


def gallery(spark: SparkSession, sf: str) -> DataFrame:
    """Items on the phone: one per line item."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.concat(F.lit("IMG_"), "l_orderkey", F.lit(".jpg")).alias("name"),
        (epoch_seconds("l_shipdate") * 1000).alias("taken_ms"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("size"),
    )


def delete_list(spark: SparkSession, sf: str) -> DataFrame:
    """Removal entries: one per finished order, every ninth without a time."""
    return (
        table(spark, sf, "orders")
        .where(F.col("o_orderstatus") == "F")
        .select(
            F.concat(F.lit("IMG_"), "o_orderkey", F.lit(".jpg")).alias("name"),
            F.when(F.col("o_orderkey") % 9 == 0, F.lit(-1).cast("bigint")).otherwise(epoch_seconds("o_orderdate")).alias("epoch"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"),
        )
    )


def chunks(events: DataFrame) -> DataFrame:
    """Upload chunks out of the events table or stream: task = user, chunk from k, two indexes out of range."""
    return events.select(
        "event_id",
        F.col("user_id").alias("task_id"),
        (json_k() % 18).alias("chunk_index"),
        F.lit(16).alias("total_chunks"),
        F.floor(F.col("value") * 10000000).cast("bigint").alias("bytes"),
        "ts",
        epoch_seconds("ts").alias("t"),
        "event_type",
    )


def poi(spark: SparkSession, sf: str) -> DataFrame:
    """Points of interest: one per supplier, around the box the photos lie in."""
    kinds = F.array(*[F.lit(k) for k in POI_KINDS])
    n = F.col("s_suppkey")
    word = F.element_at(F.array(*[F.lit(w) for w in POI_WORDS]), (n % len(POI_WORDS) + 1).cast("int"))
    return table(spark, sf, "supplier").select(
        n.alias("poi_id"),
        F.concat(word, n.cast("string")).alias("name"),
        F.when(n % 17 == 0, F.lit("")).otherwise(F.concat(F.element_at(kinds, (n % len(POI_KINDS) + 1).cast("int")), F.lit(";x;y"))).alias("type"),
        F.round(29.499 + (n % 20) * 0.0031 + (F.col("s_nationkey") % 3) * 0.0002, 6).alias("lat"),
        F.round(106.4995 + (n % 25) * 0.0027 + (F.col("s_nationkey") % 5) * 0.0003, 6).alias("lng"),
    )


POI_KINDS = [
    "风景名胜", "体育休闲服务", "餐饮服务", "住宿服务", "购物服务", "科教文化服务", "公司企业", "交通设施服务",
    "医疗保健服务", "商务住宅", "未知大类",
]
POI_WORDS = ["古镇", "公园", "博物馆", "Cafe", "酒店", "广场", "5A景区", "车站"]


def aliases(spark: SparkSession) -> DataFrame:
    """Rule list in order: boxes that rename a place or only hide its points of interest."""
    rows = [
        (0, None, True, 29.500, 106.500, 29.502, 106.510),
        (1, "老家", False, 29.512, 106.500, 29.516, 106.530),
        (2, None, False, 29.500, 106.500, 29.530, 106.520),
        (3, "江边", False, 29.530, 106.520, 29.545, 106.550),
        (4, "江边公园", True, 29.540, 106.540, 29.560, 106.570),
        (5, "北岸", False, 29.500, 106.560, 29.506, 106.580),
    ]
    return spark.createDataFrame(rows, "ordinal int, name string, block boolean, lat_min double, lng_min double, lat_max double, lng_max double")


def admin_areas(points: DataFrame) -> DataFrame:
    """Administrative names per grid point, standing in for the map service's answer."""
    a = F.round((F.col("lat") - 29.5) / 0.0031).cast("int")
    b = F.round((F.col("lng") - 106.5) / 0.0027).cast("int")

    def pick(values: list[str], i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)

    return points.select(
        "coord",
        pick(["重庆市", "四川省", "香港特别行政区", "云南省"], a % 4).alias("province"),
        F.when(a % 4 == 0, F.when(b % 2 == 0, "").otherwise("重庆市")).otherwise(pick(["", "成都市", "", "大理市"], a % 4)).alias("city"),
        pick(["两江新区", "渝中区", "大理县", "重庆市", ""], b % 5).alias("district"),
        pick(["人和街道", "", "南山镇"], b % 3).alias("township"),
    )


def sent(spark: SparkSession, sf: str) -> DataFrame:
    """Items sent for scoring: documents in batches of ten."""
    i = F.col("doc_id")
    batch = F.expr("doc_id div 10")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("b"), batch).alias("batch_id"),
        (i % 10).cast("int").alias("rank"),
        F.concat(F.lit("DOC_"), i, F.lit(".jpg")).alias("item_id"),
        F.concat(F.lit("/src/"), "source", F.lit("/"), i, F.lit("/IMG_"), i % 40, F.lit(".jpg")).alias("path"),
        (1706745600 + (batch % 28) * 86400 + (i % 10) * 601).alias("t"),
        (i % 4 != 0).alias("is_exact"),
        F.format_string("2024-02-%02d", batch % 28 + 1).alias("day"),
        F.when(i % 3 == 0, "").when(i % 3 == 1, "两江新区 公园").alias("place"),
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model A's verdicts as reply texts, one per batch of ten documents, in eight shapes."""
    d = decisions(spark, sf).where("model = 'A'")
    item = F.struct("photo_id", (F.col("decision") == "keep").alias("is_highlight"), "reason", "event_tag")
    got = d.groupBy(F.expr("doc_id div 10").alias("b")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("got"))
    got = got.withColumn("items", F.transform("got", lambda g: g["item"]))
    text, kind = F.to_json("items"), F.col("b") % 8
    reply = (
        F.when(kind == 1, F.concat(F.lit(" ```json\n"), text, F.lit("\n```\n")))
        .when(kind == 2, F.concat(F.lit('{"note": 1, "results": '), text, F.lit("}")))
        .when(kind == 3, F.array_join(F.transform("items", lambda x: F.to_json(x)), "\n"))
        .when(kind == 4, F.substring(text, F.lit(1), F.length(text) - 4))
        .when(kind == 5, F.concat(F.lit('{"data": '), text, F.lit("}")))
        .when(kind == 6, F.lit('[{"event_name": "x", "photos": ["a"]}]'))
        .when(kind == 7, F.concat(F.lit('```\n{"photos": '), text, F.lit("}\n```")))
        .otherwise(text)
    )
    return got.select(F.concat(F.lit("b"), "b").alias("batch_id"), reply.alias("reply"))


def theme_requests(spark: SparkSession, sf: str, size: int = 100) -> DataFrame:
    """Themed events in numbered chunks."""
    from albumloom.operators.progress import chunked

    return chunked(themes(spark, sf), [], ["tag"], size)


def theme_replies(numbered: DataFrame) -> DataFrame:
    """Grouping replies per chunk of numbered events, in three shapes, with one number out of range."""
    member = F.when(F.col("chunk") % 3 == 2, F.concat(F.lit('"'), "tag", F.lit('"'))).otherwise(F.col("number").cast("string"))
    lists = numbered.groupBy("chunk", "theme").agg(F.array_join(F.array_sort(F.collect_list(member)), ", ").alias("m"))
    one = F.concat(F.lit('{"theme": " '), "theme", F.lit(' ", "events": ['), "m", F.lit(', 9999]}'))
    whole = lists.groupBy("chunk").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(one)), ", "), F.lit("]")).alias("t"))
    reply = F.when(F.col("chunk") % 3 == 1, F.concat(F.lit('{"groups": '), "t", F.lit("}"))).when(F.col("chunk") % 3 == 2, F.concat(F.lit("```json\n"), "t", F.lit("\n```"))).otherwise(F.col("t"))
    return whole.select("chunk", reply.alias("reply"))


def merge_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Theme-merging replies, one per event name; the first name in its reply lists an unknown theme."""
    n = themes(spark, sf).where("NOT theme LIKE '单次%'").select(F.regexp_replace("theme", "(主题|记录)$", "").alias("name")).distinct()
    text = F.concat(
        F.lit('[{"merged_name": "'), "name", F.lit('合并", "themes": ["'), "name", F.lit('主题", "没有这个", "'), "name",
        F.when(F.col("name") == "LOW", "未知").otherwise("记录"), F.lit('"]}, {"merged_name": "单", "themes": ["'), "name", F.lit('主题"]}]'),
    )
    return n.select(F.col("name").alias("at"), text.alias("reply"))


def run_logs(spark: SparkSession, sf: str) -> DataFrame:
    """(file, at, line): run logs of the four models; some photos are judged twice, the later line counts."""
    d = decisions(spark, sf)
    kept = F.concat(F.lit("2024 [INFO]   [√] 提取 -> "), "photo_id", F.lit(" | "), "day", F.lit("-"), F.lit("x | "), "reason")
    gone = F.concat(F.lit("2024 [INFO]   [×] 剔除 -> "), "photo_id", F.lit(" | "), "reason")
    real = F.when(F.col("decision") == "keep", kept).otherwise(gone)
    early = F.when(F.col("decision") == "keep", gone).otherwise(kept)
    file = F.concat(F.lit("run_"), "model", F.lit(".log"))
    lines = d.select(file.alias("file"), (F.col("doc_id") * 10 + 5).alias("at"), real.alias("line")).unionByName(
        d.where("doc_id % 6 = 0").select(file.alias("file"), (F.col("doc_id") * 10).alias("at"), early.alias("line"))
    )
    m = F.col("model")
    per = d.groupBy("model").agg(F.count_if(F.col("decision") == "delete").alias("gone"), F.count("*").alias("n"))
    heads = [
        F.concat(F.lit("[Input] /lib/"), F.when(m == "D", "b").otherwise("a"), F.lit("  [Output] /out")),
        F.concat(F.lit("[Provider] "), F.when(m == "C", "openai").otherwise("ollama"), F.lit("  [Model] org/vision-"), F.when(m == "B", "A").otherwise(m), F.lit("-with-a-very-long-name")),
        F.concat(F.lit("[提取档位] "), F.when(m == "C", "C").otherwise("A")),
        F.concat(F.lit("   总 token:  "), F.format_number(F.col("n") * 1234, 0)),
        F.concat(F.lit("  02阶段 LLM 剔除: "), "gone", F.lit(" 张")),
        F.concat(F.lit("  合并去重后总计: "), F.col("gone") - 1, F.lit(" 张")),
    ]
    top = per.select(file.alias("file"), F.posexplode(F.array(*heads)).alias("i", "line")).select("file", (F.col("i") - 100).cast("bigint").alias("at"), "line")
    return lines.unionByName(top)


def stage_logs(spark: SparkSession, sf: str) -> DataFrame:
    """(run, at, line): pipeline logs, one run per user and one line per event."""
    k, i = F.col("k"), F.col("event_id")
    stages = F.array(*[F.lit(s) for s in ("01a", "01b", "02", "03a", "03b")])
    total, done = k + 20, F.least(k + 20, (i % 60).cast("int"))
    pct = F.format_string("%.1f", F.round(done * 100.0 / total, 1))
    count = F.concat(done.cast("string"), F.lit("/"), total.cast("string"))
    tail = F.concat(F.lit(" ("), pct, F.lit("%) | 平均 1.0 | ETA 5m03s（预计 06-12 18:30:00 完成）"))
    unit = F.element_at(F.array(F.lit(" 批"), F.lit(" 日"), F.lit(" 主题"), F.lit(" 聚类批")), (k % 4 + 1))
    line = (
        F.when(k < 6, F.concat(F.lit("▶ 阶段 "), F.element_at(stages, k % 5 + 1), F.lit("：开始")))
        .when(k < 20, F.concat(F.lit("2024 ["), F.when(k % 2 == 0, "WARNING").otherwise("ERROR"), F.lit("] odd "), i))
        .when(k < 30, F.concat(F.lit("   "), count, F.lit(" | 缓存命中 5, 新算 3")))
        .when(k < 40, F.concat(F.lit("第 "), k % 3 + 1, F.lit("/3 步：x")))
        .when(k < 70, F.concat(F.lit("[进度] "), count, unit, tail))
        .when(k < 80, F.concat(F.lit("[进度] "), F.when(k % 2 == 0, "已完成 ").otherwise("已处理 "), count, F.when(k % 2 == 0, " 批").when(k % 3 == 0, " 主题").otherwise(" 日"), F.lit(" | ETA 计算中（样本不足）")))
        .when(k < 90, F.concat(F.lit("["), count, F.lit("] 1.2 req/s, ETA 3.4min")))
        .otherwise(F.concat(F.lit("plain "), i))
    )
    e = table(spark, sf, "events").select("user_id", "event_id", json_k().alias("k"))
    return held(e, "line", line).select(F.col("user_id").alias("run"), i.alias("at"), "line", "k")


def delete_entries(spark: SparkSession, sf: str) -> DataFrame:
    """(at, name, size, taken_ms): removal list rows in list order; every fourth name is listed twice."""
    d = delete_list(spark, sf)
    key = F.regexp_extract("name", r"(\d+)", 1).cast("bigint")
    ms = F.when(F.col("epoch") > 0, F.col("epoch") * 1000).otherwise(-1)
    first = d.select((key * 2).alias("at"), "name", F.when(key % 8 == 0, -1).otherwise(F.col("size")).alias("size"), ms.alias("taken_ms"))
    again = d.where(key % 4 == 0).select((key * 2 + 1).alias("at"), "name", F.lit(-1).cast("bigint").alias("size"), F.lit(-1).cast("bigint").alias("taken_ms"))
    return first.unionByName(again)


def list_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(file, at, line): removal list files of one customer each, some with header, some broken."""
    o = table(spark, sf, "orders")
    c, i = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat(F.lit("IMG_"), i, F.lit(".jpg"))
    line = (
        F.when(i % 13 == 0, "").when(i % 13 == 1, F.concat(name, F.lit(" no pipe"))).when(i % 13 == 2, F.concat(name, F.lit("|not_a_number")))
        .when(i % 13 == 3, F.concat(name, F.lit("|4|extra"))).when(i % 13 == 4, F.concat(F.lit("  "), name, F.lit("  |  523  "))).when(i % 13 == 5, "# note").when(i % 13 == 6, "  | 77")
        .otherwise(F.concat(name, F.lit("|"), F.when(c % 3 == 0, F.floor(F.col("o_totalprice") * 100000)).otherwise(F.floor("o_totalprice")).cast("string")))
    )
    rows = o.select(F.concat(F.lit("list"), c).alias("file"), i.alias("at"), line.alias("line"))
    head = o.where(c % 4 == 0).select(F.concat(F.lit("list"), c).alias("file"), F.lit(-1).cast("bigint").alias("at"), F.when(c % 8 == 0, "#MATCH_MODE=DATETIME").otherwise(" #MATCH_MODE=SIZE ").alias("line")).distinct()
    return rows.unionByName(head)


def content_of(src: Column) -> dict[str, Column]:
    """Stand-in size and digest of a file, equal for many."""
    return {"size": F.length(src) % 4, "md5": F.md5(F.right(F.regexp_replace(src, r"\.[^.]*$", ""), F.lit(1)))}


def copy_target(files: DataFrame, mark: Column) -> DataFrame:
    """A target that holds some of the wanted names, and some digest names alone or with a number, by equal and by other files."""
    digit = F.substring(F.md5("src"), 1, 1)
    f = files.withColumn("digit", digit).withColumn("alt", add_suffix(F.col("name"), F.concat(F.lit("_"), mark, F.substring(F.md5("src"), 1, 8)))).distinct()
    f = settle(f)  # read three times
    named = f.where(F.substring(F.md5(F.concat("folder", "name")), 1, 1) < "5").groupBy("folder", "name").agg(F.max_by(F.struct("size", "md5"), "src").alias("c")).select("folder", "name", "c.*")
    own = lambda same: [F.when(same, F.col("size")).otherwise(-1).alias("size"), F.when(same, F.col("md5")).otherwise("other").alias("md5")]
    hashed = f.where("digit < '5'").select("folder", F.col("alt").alias("name"), *own(F.col("digit") < "2"))
    second = f.where("digit IN ('3', '4')").select("folder", add_suffix(F.col("alt"), F.lit("_2")).alias("name"), *own(F.col("digit") == "4"))
    return named.unionByName(hashed).unionByName(second)
