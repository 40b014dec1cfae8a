"""Document fingerprints out of closed syncmers over words: context-free anchors for positional matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumloom.llm.common import SLICES, partitions, pinned

#: a word, or 16 characters of a longer one
TOKEN = r"\S{1,16}"
#: words of a k-mer; its inner substrings are the pairs of neighbouring words
K = 5
_NO_ID = -(2**63)


def _with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Array of (pos, anchor) in ``out``: the k-mers of ``text`` that are closed syncmers.

    A k-mer of five words has four inner pairs; it is taken where the pair of smallest hash is the first or the last.
    Whether it is taken depends on these words alone, so a shared passage has the same anchors in every text.
    """
    words = F.coalesce(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    df = df.withColumn("_h", pinned(F.transform(words, lambda w: F.xxhash64(w))))
    h = F.col("_h")
    df = df.withColumn("_g", pinned(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))))
    g = F.col("_g")

    def taken(x: Column, i: Column) -> Column:
        edge, inner = F.least(x, F.get(g, i + 3)), F.least(F.get(g, i + 1), F.get(g, i + 2))
        return F.when(edge <= inner, F.xxhash64(x, F.get(g, i + 2), F.get(h, i + 4)))

    # the last K - 1 positions start no k-mer
    starts = F.slice(g, F.lit(1), F.greatest(F.lit(0), F.size(g) - (K - 1)))
    return df.withColumn(out, F.transform(starts, taken)).withColumn("_n", F.size(h)).withColumn("_all", F.xxhash64(h)).drop("_g", "_h")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds all distinct anchors of ``text``, sorted; texts without one have the hash of all their words."""
    df = _with_anchors(df, text, "_a")
    df = df.withColumn("_a", pinned(F.sort_array(F.array_distinct(F.array_compact("_a")))))
    whole = F.when(F.col("_n") > 0, F.array("_all")).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(F.size("_a") > 0, F.col("_a")).otherwise(whole)).drop("_a", "_n", "_all")


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, pos, anchor: all closed syncmers with the word they start at."""
    df = _with_anchors(docs.select("doc_id", "text"), "text", "_a")
    return df.select("doc_id", F.posexplode("_a").alias("pos", "anchor")).where("anchor IS NOT NULL")


def likeness(a: Column, b: Column) -> Column:
    """Anchors in both sets as a share of those in either; 1 if equal."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1)))


def as_text(anchors_: Column) -> Column:
    return F.array_join(F.transform(anchors_, lambda x: F.lpad(F.hex(F.shiftrightunsigned(x, 24)), 10, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half replaced by as many first characters of the next document in
    descending doc_id; after the last comes the first. Documents are dealt to slices of neighbouring ids, whose bounds
    are quantiles that occur as ids; the top document of a slice is also sent to the slice above it, so that every
    document finds its next one in its own slice and each text is shuffled once.

    A fingerprint holds every anchor of its text, so a passage in two texts shows in both, whatever their length.
    Null texts count as empty, whose fingerprint is empty. Null ids come last. Rows that repeat an id follow one
    another in text order. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    oid = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID))
    n = max(1, partitions(spark) * SLICES // 2)
    parts = [k / n for k in range(1, n + 1)]
    cuts, top = docs.select(oid.alias("oid")).agg(F.percentile_approx("oid", parts, 20 * n), F.max("oid")).first()  # one row, n numbers
    bounds = sorted({*(cuts or []), *([] if top is None else [top])}) or [_NO_ID]
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    block = F.size(F.filter(longs([b[-1] for b in blocks]), lambda x: x < F.col("oid")))
    inside = F.element_at(F.array(*map(longs, blocks)), F.col("_block") + 1)
    slot = F.size(F.filter(F.col("_inside"), lambda x: x < F.col("oid")))

    full = docs.select("doc_id", oid.alias("oid"), F.coalesce("text", F.lit("")).alias("text"))
    full = full.withColumn("_block", block).withColumn("_inside", inside).withColumn("_slot", slot)
    own = F.col("_block") * step + F.col("_slot")
    above = F.when(F.element_at("_inside", F.col("_slot") + 1) == F.col("oid"), (own + 1) % len(bounds))
    full = full.withColumn("_at", F.array(F.struct(F.lit(0).alias("visit"), own.alias("slice")), F.struct(F.lit(1).alias("visit"), above.alias("slice"))))
    dealt = full.select("doc_id", "oid", "text", F.explode("_at").alias("at")).select("doc_id", "oid", "text", "at.*").where("slice IS NOT NULL")
    # fingerprints grow with the text, so they are made where the slices are and not shuffled
    dealt = with_fingerprint(dealt.repartition("slice"), "text", "fp")

    down = Window.partitionBy("slice").orderBy("visit", F.desc("oid"), "text")
    both = dealt.withColumn("next_text", F.lead("text").over(down)).withColumn("next_fp", F.lead("fp").over(down)).where("visit = 0")
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next_text", F.lit(1), half))
    out = with_fingerprint(both.withColumn("edited", edited), "edited", "edited_fp")
    return out.select(
        "doc_id",
        chars.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
