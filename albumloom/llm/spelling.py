"""Spelling variants: bitsets per (position, letter) over words, and recurrences that follow no-error and one-error sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumloom.llm.common import stored
from albumloom.llm.linedup import lowered

RUN = r"[A-Za-zÀ-ÿ]+"


@dataclass(frozen=True)
class Spelling:
    """``words`` and ``block`` bound the words of a task's group: of many small buckets, of two blocks of a large one."""

    every: int = 97
    least_chars: int = 5
    least_count: int = 3
    ratio: int = 2
    words: int = 8192
    block: int = 512


def vocabulary(docs: DataFrame, p: Spelling = Spelling()) -> DataFrame:
    """(doc_id, text) -> word, n: letter runs of whole texts, a letter left out where the run's checksum says so.

    The checksum of a row without an id is null, so its runs stay as they are. Null texts have no runs.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % p.every == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= p.least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= p.least_count)


def near_pairs(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in ``words``, all of n or n + 1 letters, where word i has n and word j is one edit away.

    Bit j of the bitset of (position, letter) says that word j has that letter there. Row i of ``zero`` holds the words
    that begin with the first letters of word i, ``swap`` those that do but for one replaced letter, ``more`` those
    with one letter too many so far, which are read one position further on. All are carried on together, 64 words
    at a time; the bitsets of a position are made when it is reached.
    """
    size = len(words)
    letters = np.frombuffer("".join(w.ljust(n + 1, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(size, n + 1)
    alphabet, codes = np.unique(letters, return_inverse=True)
    codes = codes.reshape(letters.shape).astype(np.int64)
    wide = -(-size // 64) * 64

    def bits(flags: np.ndarray) -> np.ndarray:
        padded = np.zeros((*flags.shape[:-1], wide), bool)
        padded[..., :size] = flags
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    def position(at: int) -> np.ndarray:
        return bits((codes[:, at] == np.arange(len(alphabet))[:, None]) & (alphabet != 0)[:, None])

    long = codes[:, n] != (0 if alphabet[0] == 0 else -1)
    asks = np.flatnonzero(~long)
    if not len(asks):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    zero = np.broadcast_to(bits(np.ones(size, bool)), (len(asks), wide // 64)).copy()
    swap, more, here = np.zeros_like(zero), zero.copy(), position(0)
    for at in range(n):
        after, letter = position(at + 1), codes[asks, at]
        same = here[letter]
        swap = (swap & same) | (zero & ~same)
        zero &= same
        more = (more & after[letter]) | zero
        here = after
    found = (swap & bits(~long)) | (more & bits(long))
    rows = np.flatnonzero(found.any(axis=1))
    i, j = np.nonzero(np.unpackbits(found[rows].view(np.uint8), axis=1, bitorder="little"))
    return asks[rows[i]], j


def _near_in_cell(cell: pd.DataFrame) -> pd.DataFrame:
    out = []
    for n, part in cell.groupby("short", sort=False):
        part = part.drop_duplicates("word")
        words, counts = part["word"].to_numpy(), part["n"].to_numpy()
        i, j = near_pairs(list(words), int(n))
        out.append(pd.DataFrame({"word": words[i], "n": counts[i], "near": words[j], "near_n": counts[j]}))
    both = pd.concat(out)
    back = both.rename(columns={"word": "near", "n": "near_n", "near": "word", "near_n": "n"})
    return pd.concat([both, back[["word", "n", "near", "near_n"]]]).drop_duplicates(["word", "near"])


def near_words(words: DataFrame, p: Spelling = Spelling()) -> DataFrame:
    """(word, n) -> word, n, near, near_n: both orders of every two words one edit apart, each once.

    Of two such words the shorter, of s letters (or either), has the same first s // 2 letters as the other or the same
    last s - s // 2: the edit is behind the one or before the other. So a word stands in the buckets of its first and of
    its last letters, for s its own length and one less, and no pair is missed. Small buckets share a task's group up to ``words``;
    a bucket of more than two blocks is dealt into blocks by hash, and each two blocks meet in a group of their own,
    however large the bucket. Words of a group are compared by ``near_pairs``, whatever bucket they come from.
    """
    size = F.length("word")
    shorts = F.filter(F.array(size, size - 1), lambda s: s >= p.least_chars)
    each = words.select("word", "n", F.explode(shorts).alias("short"))
    half = F.floor(F.col("short") / 2).cast("int")
    first = F.xxhash64(F.lit("first"), F.col("short"), F.substring("word", F.lit(1), half))
    last = F.xxhash64(F.lit("last"), F.col("short"), F.substring("word", size - F.col("short") + half + 1, size))
    keyed = stored(each.select("word", "n", "short", F.explode(F.array(first, last)).alias("bucket")), "keyed")
    sizes = stored(keyed.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    held = keyed.join(sizes, "bucket")
    total = sizes.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]  # one number
    groups = max(1, -(-total // p.words))
    blocks = F.ceil(F.col("c") / p.block)
    own = F.pmod(F.xxhash64(F.lit("block"), "word"), blocks)
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda o: F.xxhash64("bucket", F.least(o, own), F.greatest(o, own)))
    cells = F.when(F.col("c") <= 2 * p.block, F.array(F.pmod(F.col("bucket"), F.lit(groups)))).otherwise(meets)
    dealt = held.select("word", "n", "short", F.explode(cells).alias("cell"))
    found = dealt.groupBy("cell").applyInPandas(_near_in_cell, "word string, n bigint, near string, near_n bigint")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> word, root: the end of each chain of forms, by doubling; a word that is no form's word is an end."""
    links = stored(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(links.join(on, "root", "left").select("word", "root", "next"), "links")
        if further.where("next IS NOT NULL").isEmpty():
            return further.select("word", "root")
        links = further.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, p: Spelling = Spelling()) -> DataFrame:
    """(doc_id, text) -> word, form, root, n, n_near, form_n: one row per word of the vocabulary.

    Words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near word
    of largest n, of several the first in code-point order, if that n is ``ratio`` times the word's or more. Forms grow by
    that ratio, so chains end after few steps.

    Null and empty texts have no words; runs of any length are words; repeated rows are counted as often as they
    stand there; runs in rows without an id are counted unaltered. An empty table gives no rows. Other columns are not read.
    """
    words = stored(vocabulary(docs.select("doc_id", "text"), p), "words")
    near = near_words(words, p)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    told = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= F.col("n") * p.ratio
    told = stored(
        told.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "told"
    )
    ends = roots(told.where("form IS NOT NULL"))
    out = words.join(told, "word", "left").join(ends, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"
    )
