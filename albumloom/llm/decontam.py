"""Benchmark decontamination: size-partitioned MinHash containment search, verified on whole shingle sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumloom.llm.common import pinned

TOKEN = r"[\p{L}\p{N}]++"


@dataclass(frozen=True)
class Containment:
    """A document is contaminated by an item if it holds ``least`` percent of the item's distinct ``words``-word shingles.

    ``spare`` is how many minhashes an item has beyond the number that cannot miss.
    """

    words: int = 5
    least: int = 80
    spare: int = 0


def _with_tokens(df: DataFrame, out: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    return df.withColumn(out, pinned(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.xxhash64(t))))


def _grams(tokens: str, words: int) -> Column:
    """Hashes of the runs of ``words`` tokens, repeats included; none for a shorter text."""
    t = F.col(tokens)
    return F.transform(
        F.slice(t, F.lit(1), F.greatest(F.lit(0), F.size(t) - (words - 1))),
        lambda x, i: F.xxhash64(x, *[F.get(t, i + k) for k in range(1, words)]),
    )


def contaminated(docs: DataFrame, items: DataFrame, p: Containment = Containment()) -> DataFrame:
    """(doc_id, text) and items (item_id, text) -> doc_id, item_id, n_item, n_shared, containment of contaminated pairs.

    Words are runs of letters and digits, lower-cased. Items are partitioned by powers of two of their number of
    shingles. An item's signature is its smallest shingle hashes, so many by its partition's largest size that a
    document with the asked containment must hold one of them: at most (100 - least) percent of the shingles can be
    missing, so one more than that cannot all be. Documents meet signatures in an equi-join on the hash, after a cut
    at the largest signature hash; no candidate of the asked containment is lost. Candidates are then decided on the
    whole shingle sets.

    Texts and items of fewer words than a shingle, nulls and empty texts match nothing. Copies of a text are
    candidates once and reported each; repeated items are looked for once. Other columns are not read.
    """
    sized = _with_tokens(items.select("item_id", "text"), "_t").withColumn("grams", F.sort_array(F.array_distinct(_grams("_t", p.words))))
    sized = sized.where(F.size("grams") > 0).select(F.xxhash64("item_id", "text").alias("item"), "item_id", "grams", F.size("grams").alias("n_item")).dropDuplicates(["item"])
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1).cast("int") - 1
    m = F.floor(largest * (100 - p.least) / 100).cast("int") + 1 + p.spare
    signed = sized.select("item", F.explode(F.slice("grams", F.lit(1), m)).alias("gram"))
    cut = signed.agg(F.coalesce(F.max("gram"), F.lit(-(2**63)))).scalar()

    texts = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("same"))
    probes = _with_tokens(texts.select("text", "same"), "_t").select("same", _grams("_t", p.words).alias("grams"))
    probes = probes.select("same", F.explode_outer("grams").alias("gram")).where(F.col("gram") <= cut)
    pairs = probes.join(signed, "gram").select("same", "item").distinct()

    found = texts.join(pairs.hint("shuffle_hash"), "same").join(sized, "item")
    found = _with_tokens(found, "_t").withColumn("n_shared", F.size(F.array_intersect("grams", _grams("_t", p.words))))
    return found.where(F.col("n_shared") * 100 >= F.col("n_item") * p.least).select(
        "doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )
