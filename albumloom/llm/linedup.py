"""Line dedup: normalised lines exploded and hashed, documents counted per hash, frequent lines dropped, texts put together again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumloom.llm.common import pinned, stored

#: ASCII white space, cut off at both ends of a line
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineDedup:
    """Keys of ``least_chars`` code points or more that ``least_docs`` documents or more hold are dropped everywhere."""

    least_docs: int = 10
    least_chars: int = 1


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() is the faster way to that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lowered(F.btrim(line, F.lit(BLANK)))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, pos, hi, lo of every line; ``mark`` is the text's hash, hi and lo together are the key's."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = cut.withColumn("key", line_key(F.col("line")))
    return key.select("doc_id", "mark", "pos", F.length("key").alias("chars"), F.xxhash64("key").alias("hi"), F.xxhash64(F.lit("second"), "key").alias("lo"))


def frequent_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """(doc_id, text) -> hi, lo, docs: hashes of the keys that enough documents hold, with how many do.

    doc_id names a document, so rows that repeat one count once; rows without doc_id count once for each text.
    """
    lines = _lines(docs).where(F.col("chars") >= p.least_chars)
    own = F.when(F.col("doc_id").isNull(), F.col("mark"))
    once = lines.select("hi", "lo", "doc_id", own.alias("own")).distinct()
    return once.groupBy("hi", "lo").agg(F.count("*").alias("docs")).where(F.col("docs") >= p.least_docs)


def without_lines(texts: DataFrame, lines: str, dropped: str, out: str) -> DataFrame:
    """Adds array ``out``: ``lines`` without the places (from 0, ascending) in ``dropped``, put together from the stretches between."""
    texts = texts.withColumn("_ends", pinned(F.concat(F.array(F.lit(-1)), F.col(dropped), F.array(F.size(lines)))))
    stretch = lambda at, i: F.slice(lines, at + 2, F.get("_ends", i + 1) - at - 1)
    starts = F.slice("_ends", F.lit(1), F.size("_ends") - 1)
    return texts.withColumn(out, F.flatten(F.transform(starts, stretch))).drop("_ends")


def line_dedup(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """(doc_id, text) -> doc_id, n_lines, n_dropped, kept_text: one row per row, without the lines that many documents have.

    Lines are what \\n cuts; a null or empty text is one empty line. Which lines go is decided by whole keys, case and
    blank ends apart; what stays is unchanged and in its order, a text all of whose lines go becomes empty. The hashes
    of frequent lines are a table that lines are joined with, so a line that a third of all documents hold is spread
    over tasks; of the lines only those that go are gathered, as places per document, and each text is shuffled once.

    Rows that repeat an id and a text have equal results; rows that repeat an id with other texts have their own each
    and count as one document. Rows without an id count once for each text. Very long texts are only ever one row with
    their own places. Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    often = stored(frequent_lines(docs, p).select("hi", "lo"), "frequent")
    hit = _lines(docs).where(F.col("chars") >= p.least_chars).join(often, ["hi", "lo"])
    # a place of a text is gathered once, however many rows have that id and text
    gone = stored(hit.select("doc_id", "mark", "pos").distinct(), "places")
    gone = stored(gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "gone")
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))
    same = marked["doc_id"].eqNullSafe(gone["doc_id"]) & (marked["mark"] == gone["mark"])
    both = marked.join(gone.hint("shuffle_hash"), same, "left").select(marked["doc_id"], "text", "gone")
    cut = both.withColumn("lines", pinned(F.split("text", "\n", -1)))
    cut = without_lines(cut.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))), "lines", "gone", "kept")
    return cut.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("gone").cast("bigint").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )
