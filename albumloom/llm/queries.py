"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.llm import decontam, language, linedup, mixing, neardup, quality, sharding, spelling, syncmers, tokencount, toxicity, urlfilter, whitening
from albumloom.llm.common import held_out, table

TOKENIZERS = "/opt/tokenizers"
#: the rules that op8 is asked to apply
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    out = toxicity.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), neardup.NearDup(words=4))


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf, "documents"))


def op5_language(spark: SparkSession, sf: str, vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.learn(docs, vocabulary, held_out(4, 2))
    out = language.identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    return tokencount.token_counts(table(spark, sf, "documents"), vocabulary)


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(table(spark, sf, "pages"), rules)


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    out = sharding.shard(table(spark, sf, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = linedup.line_dedup(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_mixing, op3_near_duplicates, op4_fingerprints, op5_language, op6_token_counts, op7_decontamination, op8_url_filters, op9_sharding, op10_quality,
        op11_spelling_variants, op12_line_dedup, op13_whitening,
    )
}

SQL = {
    "op8_url_filters": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""",
    "op12_line_dedup": r"""
WITH lines AS (
  SELECT row_no, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_no, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), often AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often USING (key) GROUP BY row_no, doc_id
""",
}
