"""Progress read off run logs: stages, counters, remaining time, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumloom.functions.replies import held
from albumloom.operators.ordering import running_max

# fixed values: stage ids in order and log line shapes
STAGES = ["01a", "01b", "02", "03a", "03b"]
STAGE = r"▶\s*阶段\s*(01a|01b|02|03a|03b)\b"
WARN = r"\[(?:WARNING|ERROR)\]"
HASHED = r"(\d+)/(\d+)\s*\|\s*缓存命中"
STEP = r"第\s*([123])/3\s*步"
COUNTER = r"\[进度\]\s*(已完成|已处理)?\s*(\d+)/(\d+)\s*(聚类批|批|日|主题)"
PERCENT = r"\[进度\]\s*\d+/\d+\s*(?:聚类批|批|日|主题)\s*\(([\d.]+)%\)"
ETA = r"\[进度\].*?ETA\s*(.+?)（预计\s*(.+?)\s*完成）"
LOOKUP = r"(?i)\[(\d+)/(\d+)\].*?ETA\s*([\d.]+)\s*min"
STEP_FLOOR = {1: 0.05, 2: 0.15, 3: 0.90}


def _num(text: Column) -> Column:
    return F.when(text != "", text).try_cast("bigint")


def progress_lines(lines: DataFrame) -> DataFrame:
    """(run, at, line) -> kind, done, total, bar (0..1), eta, finish of the lines that tell progress."""
    line = F.col("line")

    def groups(pattern: str, n: int) -> Column:
        """The groups of the first match; empty when there is none."""
        hit = F.regexp_substr(line, F.lit(pattern))
        return F.coalesce(F.split(F.regexp_replace(hit, f".*?{pattern}.*", "\u0001".join(f"${i}" for i in range(1, n + 1))), "\u0001"), F.array().cast("array<string>"))

    shapes = {"stage": (STAGE, 1), "hashed": (HASHED, 2), "step": (STEP, 1), "counter": (COUNTER, 4), "percent": (PERCENT, 1), "eta": (ETA, 2), "lookup": (LOOKUP, 3)}
    # every pattern runs once per line; what follows works on the groups
    found = lines.select("run", "at", F.struct(*[groups(p, n).alias(k) for k, (p, n) in shapes.items()]).alias("f"))
    found = found.select("run", "at", *[F.col(f"f.{k}").alias(f"g_{k}") for k in shapes])

    def g(shape: str, i: int) -> Column:
        return F.coalesce(F.get(f"g_{shape}", F.lit(i - 1)), F.lit(""))

    stage, step, unit, note = g("stage", 1), g("step", 1), g("counter", 4), g("counter", 1)
    read = F.struct(
        stage.alias("stage"), step.alias("step"), unit.alias("unit"), note.alias("note"),
        _num(g("counter", 2)).alias("c_done"), _num(g("counter", 3)).alias("c_total"), _num(g("hashed", 1)).alias("h_done"), _num(g("hashed", 2)).alias("h_total"),
        _num(g("lookup", 1)).alias("l_done"), _num(g("lookup", 2)).alias("l_total"), g("lookup", 3).alias("l_min"),
        (F.when(g("percent", 1) != "", g("percent", 1)).try_cast("double") / 100).alias("pct"), g("eta", 1).alias("eta"), g("eta", 2).alias("finish"),
    )
    # held apart, so that the rules below stay small enough to be compiled
    found = held(found, "x", read).select("run", "at", "x.*")
    unit, note, pct = F.col("unit"), F.col("note"), F.col("pct")
    full = (F.col("eta") != "") & pct.isNotNull()
    warm = ((unit == "批") & (note == "已完成")) | (unit.isin("日", "主题") & (note == "已处理"))
    units = F.create_map(*[F.lit(x) for x in ("批", "batches", "日", "days", "主题", "themes", "聚类批", "clusters")])
    kind = (
        F.when(F.col("stage") != "", "stage")
        .when(F.col("h_done").isNotNull(), "hashing")
        .when(F.col("step") != "", "step")
        .when((unit != "") & ((full & (note == "")) | warm | ((unit == "聚类批") & pct.isNotNull())), F.element_at(units, unit))
        .when(F.col("l_done").isNotNull(), "lookup")
    )
    told = held(found, "kind", kind).where("kind IS NOT NULL")
    k = F.col("kind")
    counted = k.isin("batches", "days", "themes", "clusters")
    done = F.when(k == "hashing", F.col("h_done")).when(counted, F.col("c_done")).when(k == "lookup", F.col("l_done"))
    total = F.when(k == "hashing", F.col("h_total")).when(counted, F.col("c_total")).when(k == "lookup", F.col("l_total"))
    told = told.withColumns({"done": done, "total": total})
    ratio = F.coalesce(F.try_divide("done", "total"), F.lit(0.0))
    inner = F.coalesce(F.when(full | (k == "clusters"), pct), ratio)
    floors = F.element_at(F.array(*[F.lit(v) for v in STEP_FLOOR.values()]), F.coalesce(_num(F.col("step")), F.lit(1)).cast("int"))
    bar = (
        F.when(k == "stage", 0.0)
        .when(k == "hashing", ratio * (STEP_FLOOR[3] - STEP_FLOOR[2]) + STEP_FLOOR[2])
        .when(k == "themes", inner * 0.5 + 0.5)
        .when(k == "clusters", inner * 0.5)
        .when(counted, inner)
        .when(k == "lookup", ratio)
        .otherwise(floors)
    )
    return told.select(
        "run", "at", "kind", F.when(k == "stage", F.col("stage")).alias("stage"), "done", "total", F.round(bar, 6).alias("bar"),
        F.when(counted & full, F.trim("eta")).when(k == "lookup", F.concat("l_min", F.lit("min"))).alias("eta"), F.when(counted & full, F.trim("finish")).alias("finish"),
    )


def warnings_per_stage(lines: DataFrame) -> DataFrame:
    """(run, at, line) with ``at`` a line number -> warning and error lines per run and stage they fell in."""
    stage = F.regexp_extract("line", STAGE, 1)
    rows = lines.select("run", F.col("at").alias("pos"), F.when(stage != "", stage).alias("stage"), ((stage == "") & F.col("line").rlike(WARN)).alias("warn"))
    rows = running_max(rows.where("warn OR stage IS NOT NULL"), ["run"], {"head": F.when(F.col("stage").isNotNull(), F.struct("pos", "stage"))})
    return rows.where("warn").groupBy("run", F.coalesce("head.stage", F.lit("?")).alias("stage")).agg(F.count("*").alias("warnings"))


def stage_states(lines: DataFrame, skipped: list[str]) -> DataFrame:
    """State of each stage after the last header of a run: done before it, running, pending after; skipped stays."""
    stage = F.regexp_extract("line", STAGE, 1)
    last = lines.where(stage != "").groupBy("run").agg(F.max_by(stage, "at").alias("current"))
    order = F.array(*[F.lit(s) for s in STAGES])
    now = F.array_position(order, F.col("current"))
    rows = last.select("run", now.alias("now"), F.posexplode(order).alias("i", "stage"))
    state = F.when(F.col("i") + 1 == F.col("now"), "running").when(F.col("stage").isin(*skipped) if skipped else F.lit(False), "skipped").when(F.col("i") + 1 < F.col("now"), "done").otherwise("pending")
    return rows.select("run", "stage", state.alias("state"))
