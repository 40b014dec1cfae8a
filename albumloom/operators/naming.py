"""Destination names of copy and move plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumloom.functions.names import add_suffix
from albumloom.operators.ordering import in_order
from albumloom.session import settle


#: what tells files apart: sizes first, digests where these are equal
CONTENT = ("size", "md5")


def plan_copies(files: DataFrame, mark: Column | None = None, same: str | None = None, target: DataFrame | None = None, numbered: bool = True) -> DataFrame:
    """(folder, name, src, ...) -> ``final_name`` and ``status`` for each source.

    ``target`` lists what is there already: folder, name, size, md5; files then bring size and md5 as well. A name is held by the file
    that is there, else by the first source (by path), which is ``copied``. Whoever equals the holder is ``exists_same`` and not
    copied. Others get the first eight md5 digits of their path, after ``mark`` when given (``copied_hashed``), unless that
    name is taken too: by an equal file it is ``exists_same``, by another one the source gets the first number from 2
    that is free, or is a ``conflict`` and not copied where names are not ``numbered``. Names that are wanted as such go before
    digest names. Holders are grouped minima joined back, so a name shared by very many sources is never ranked in one
    task. Without a target and with ``same``, one column stands for the content.
    """
    files = settle(files)  # read by each of the steps below
    if target is None:
        content = F.col(same) if same else F.lit(None).cast("string")
        rows = files.withColumn("_c_size", content).withColumn("_c_md5", content)
        there = files.select("folder", "name").where("false").withColumns({f"_t_{c}": F.lit(None).cast("string") for c in CONTENT})
    else:
        rows = files.withColumns({f"_c_{c}": F.col(c).cast("string") for c in CONTENT})
        there = target.select("folder", "name", *[F.col(c).cast("string").alias(f"_t_{c}") for c in CONTENT])
    held = [f"_c_{c}" for c in CONTENT]
    equal = lambda p: (F.coalesce(F.col(held[0]) == F.col(f"{p}{CONTENT[0]}"), F.lit(False)) & F.coalesce(F.col(held[1]) == F.col(f"{p}{CONTENT[1]}"), F.lit(False)))
    first = settle(rows.groupBy("folder", "name").agg(F.min_by(F.struct("src", *held), "src").alias("_h")))  # read for holders and taken names
    holder = first.join(there.withColumn("_there", F.lit(True)), ["folder", "name"], "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    holder = holder.select("folder", "name", "_there", F.col("_h.src").alias("_first"), *[F.when(F.col("_there"), F.col(f"_t_{c}")).otherwise(F.col(f"_h._c_{c}")).alias(f"_h_{c}") for c in CONTENT])
    rows = rows.join(holder, ["folder", "name"])
    holds = ~F.col("_there") & (F.col("src") == F.col("_first"))
    rows = settle(rows.withColumn("_state", F.when(holds, "copied").when(equal("_h_"), "exists_same")))
    keep = [*files.columns, "final_name", "status"]
    settled = rows.where("_state IS NOT NULL").withColumn("final_name", F.col("name")).withColumn("status", F.col("_state"))

    digest = F.substring(F.md5("src"), 1, 8)
    tail = F.concat(F.lit("_"), digest) if mark is None else F.concat(F.lit("_"), mark, F.lit("_"), digest)
    alt = rows.where("_state IS NULL").drop("_there", "_first", "_state", *[f"_h_{c}" for c in CONTENT]).withColumn("_alt", add_suffix(F.col("name"), tail))
    # every name that is taken before digest names are given out
    taken = there.unionByName(first.join(there, ["folder", "name"], "left_anti").select("folder", "name", *[F.col(f"_h._c_{c}").alias(f"_t_{c}") for c in CONTENT]))
    alt = alt.join(taken.withColumnRenamed("name", "_alt").withColumn("_taken", F.lit(True)), ["folder", "_alt"], "left")
    # rows here share folder, name and 32 digest bits: a handful at most
    group = Window.partitionBy("folder", "_alt").orderBy("src")
    alt = alt.withColumn("_rank", F.row_number().over(group)).withColumns({f"_f_{c}": F.first(f"_c_{c}").over(group) for c in CONTENT})
    free = F.col("_taken").isNull()
    state = F.when(free & (F.col("_rank") == 1), "copied_hashed").when((~free & equal("_t_")) | (free & equal("_f_")), "exists_same")
    alt = settle(alt.withColumn("_state", state))
    plain = alt.where("_state IS NOT NULL").withColumn("final_name", F.col("_alt")).withColumn("status", F.col("_state"))
    out = settled.select(*keep).unionByName(plain.select(*keep))
    left = alt.where("_state IS NULL").drop("_taken", "_state", "_rank", *[f"{p}{c}" for p in ("_t_", "_f_") for c in CONTENT])
    if not numbered:
        return out.unionByName(left.withColumn("final_name", F.col("_alt")).withColumn("status", F.lit("conflict")).select(*keep))
    return out.unionByName(_numbered(left, taken, equal).select(*keep))


def _numbered(left: DataFrame, taken: DataFrame, equal: Callable[[str], Column]) -> DataFrame:
    """Sources whose digest name is another file's: the first free number, or the number of an equal file.

    The r-th free number from 2 on is r + 1 and one more for each taken number, in order the i-th and of value t, below
    which fewer than r are free: t - 1 - i < r. Few names are followed by a number, so each name's are a short list.
    """
    n = F.regexp_extract("name", r"_(\d{1,9})(\.[^.]*)?$", 1)
    named = taken.withColumn("_n", n.try_cast("int")).where("_n >= 2").withColumn("_alt", F.regexp_replace("name", r"_\d{1,9}((\.[^.]*)?)$", "$1"))
    named = named.where(F.col("name") == add_suffix(F.col("_alt"), F.concat(F.lit("_"), F.col("_n").cast("string"))))
    lists = named.groupBy("folder", "_alt").agg(F.sort_array(F.collect_list(F.struct("_n", *[f"_t_{c}" for c in CONTENT]))).alias("_list"))
    rows = left.join(lists, ["folder", "_alt"], "left").withColumn("_list", F.coalesce("_list", F.array().cast("array<struct<_n:int,_t_size:string,_t_md5:string>>")))
    like = F.filter("_list", lambda x: F.coalesce((x["_t_size"] == F.col("_c_size")) & (x["_t_md5"] == F.col("_c_md5")), F.lit(False)))
    rows = rows.withColumn("_like", F.get(F.transform(like, lambda x: x["_n"]), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("folder", "_alt", F.col("_like").isNull()).orderBy("src"))
    rows = rows.withColumn("_rank", rank)
    below = F.filter(F.transform("_list", lambda x, i: x["_n"] - 2 - i), lambda free: free < F.col("_rank"))
    number = F.coalesce("_like", F.col("_rank") + 1 + F.size(below))
    return rows.withColumn("final_name", add_suffix(F.col("_alt"), F.concat(F.lit("_"), number.cast("string")))).withColumn(
        "status", F.when(F.col("_like").isNotNull(), "exists_same").otherwise("copied_hashed")
    )


def listing(plan: DataFrame, target: DataFrame) -> DataFrame:
    """What the target holds once a plan has been carried out."""
    new = plan.where("status IN ('copied', 'copied_hashed')").select("folder", F.col("final_name").alias("name"), *CONTENT)
    return target.select("folder", "name", *CONTENT).unionByName(new)


def plan_folders(folders: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Folders that ask for one name get it, name_v2, name_v3 ... in order."""
    placed = in_order(folders, [key], order)
    return placed.withColumn("final_folder", F.when(F.col("pos") == 0, F.col(key)).otherwise(F.concat(key, F.lit("_v"), (F.col("pos") + 1).cast("string")))).drop("pos")


def execute_plan(plan: DataFrame, base: str) -> None:
    """Copy every planned file with plain file operations on the executors; a file that is there already is left.

    For local or mounted storage. Each task copies its own rows to a temporary name and renames it, so a task
    that runs again does no harm.
    """

    def run(rows) -> None:
        import os
        import shutil

        for r in rows:
            target = os.path.join(base, r["folder"], r["final_name"])
            if r["status"] in ("exists_same", "conflict") or os.path.exists(target):
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{os.getpid()}.part"
            shutil.copy2(r["src"], part)
            os.replace(part, target)

    plan.select("folder", "final_name", "status", "src").foreachPartition(run)
