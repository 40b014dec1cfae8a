"""Photo scanning, duplicate removal, segments, events and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.operators import batches, duplicates, segments
from albumloom.params import Chunking
from albumloom.plans.oracle import PHOTOS, with_
from albumloom.plans.registry import query
from albumloom.plans.views import photos
from albumloom.session import settle

DIST = "(bit_count(xor(a_hi, b_hi)) + bit_count(xor(a_lo, b_lo)))::INT"
# settings under which the given tables show all branches: hashes of different shots lie about 32 bits apart
WIDE = Chunking(segment_max_bits=33, merge_max_bits=24)


def stage_sql(p: Chunking) -> list[str]:
    """Row-level SQL for segments, segment pairs and merged events over a ``photos_in`` relation."""
    return [
        """ordered AS (
  SELECT *, lag(t) OVER w AS pt, lag(hash_hi) OVER w AS a_hi, lag(hash_lo) OVER w AS a_lo, hash_hi AS b_hi, hash_lo AS b_lo
  FROM photos_in WINDOW w AS (PARTITION BY day ORDER BY t, photo_id))""",
        f"""segmented AS (
  SELECT *, sum(CASE WHEN pt IS NULL OR t - pt < {p.burst_seconds} THEN 0 WHEN t - pt > {p.hard_cut_seconds} THEN 1
                     WHEN a_hi IS NULL OR b_hi IS NULL THEN 0 WHEN {DIST} > {p.segment_max_bits} THEN 1 ELSE 0 END)
            OVER (PARTITION BY day ORDER BY t, photo_id)::BIGINT AS segment FROM ordered)""",
        """segs AS (
  SELECT day, segment, min(t) AS start_t, max(t) AS end_t, count(*) AS n,
         arg_min(hash_hi, (t, photo_id)) FILTER (hash_hi IS NOT NULL) AS hash_hi,
         arg_min(hash_lo, (t, photo_id)) FILTER (hash_hi IS NOT NULL) AS hash_lo
  FROM segmented GROUP BY day, segment)""",
        f"""pairs AS (
  SELECT a.day, a.segment AS "first", b.segment AS "second" FROM segs a JOIN segs b ON a.day = b.day AND a.segment < b.segment
  WHERE b.end_t - a.start_t <= {p.merge_span_seconds}
    AND bit_count(xor(a.hash_hi, b.hash_hi)) + bit_count(xor(a.hash_lo, b.hash_lo)) <= {p.merge_max_bits})""",
        """links AS (SELECT day, "first" AS a, "second" AS b FROM pairs UNION SELECT day, "second", "first" FROM pairs)""",
        """reach(day, segment, event) AS (
  SELECT day, segment, segment FROM segs
  UNION SELECT r.day, l.b, r.event FROM reach r JOIN links l ON l.day = r.day AND l.a = r.segment WHERE r.event < l.b)""",
        """seg_event AS (SELECT day, segment, min(event) AS event FROM reach GROUP BY day, segment)""",
    ]


def all_photos(cond: str = "") -> str:
    return f"photos_in AS (SELECT * FROM photos {cond})"


TRASH_SQL = """CASE WHEN size_bytes < 30720 THEN 'size_too_small' WHEN width < 400 OR height < 400 THEN 'resolution_too_low'
  WHEN greatest(width, height)::DOUBLE / least(width, height) > 3.0 THEN 'extreme_aspect_ratio' END"""

STEM_SQL = r"lower(regexp_replace(filename, '([^.]\.*)(\.[^.]*)$', '\1'))"
NODES = f"named AS (SELECT *, {STEM_SQL} AS stem FROM photos)"
MATCHES = r"""matches AS (
  SELECT a.photo_id AS a, b.photo_id AS b FROM named a JOIN named b ON a.day = b.day AND a.photo_id <> b.photo_id
  WHERE bit_count(xor(a.hash_hi, b.hash_hi)) + bit_count(xor(a.hash_lo, b.hash_lo)) <= 2
    AND (a.stem = b.stem
      OR (len(a.stem) < len(b.stem) AND starts_with(b.stem, a.stem) AND NOT regexp_matches(b.stem[len(a.stem) + 1], '\d'))
      OR (len(b.stem) < len(a.stem) AND starts_with(a.stem, b.stem) AND NOT regexp_matches(a.stem[len(b.stem) + 1], '\d'))))"""
GROUPS = """walk(id, grp) AS (
  SELECT photo_id, photo_id FROM photos UNION SELECT m.b, w.grp FROM walk w JOIN matches m ON m.a = w.id WHERE w.grp < m.b),
grouped AS (SELECT p.*, g.grp AS group_id FROM photos p JOIN (SELECT id, min(grp) AS grp FROM walk GROUP BY id) g ON g.id = p.photo_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size_bytes DESC, t, photo_id) AS rn FROM grouped) WHERE rn = 1)"""


@query("FIL-1", sql=with_(PHOTOS, body=f"SELECT photo_id, {TRASH_SQL} AS reason FROM photos"))
def junk_filter(spark: SparkSession, sf: str) -> DataFrame:
    return photos(spark, sf).select("photo_id", duplicates.is_trash().alias("reason"))


@query("FIL-1", sql=with_(PHOTOS, body=f"SELECT reason, count(*) AS n FROM (SELECT {TRASH_SQL} AS reason FROM photos) WHERE reason IS NOT NULL GROUP BY reason"))
def junk_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return photos(spark, sf).select(duplicates.is_trash().alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("FIL-2", sql=with_(PHOTOS, body="""SELECT photo_id, CASE WHEN width <= 0 OR height <= 0 THEN '无法读取图片尺寸'
  WHEN width < 400 OR height < 400 THEN '分辨率过小 (' || width || 'x' || height || ')'
  WHEN greatest(width, height)::DOUBLE / least(width, height) > 3.0 THEN '长宽比异常 (' || round((greatest(width, height)::DOUBLE / least(width, height))::DECIMAL(18, 6), 1) || ')' END AS reason
  FROM photos"""))
def upload_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.functions.rules import upload_rejection

    return photos(spark, sf).select("photo_id", upload_rejection(F.col("width"), F.col("height")).alias("reason"))


@query("SCL-10", sql=with_(PHOTOS, body=f"""SELECT a.photo_id, b.photo_id AS other_id, (bit_count(xor(a.hash_hi, b.hash_hi)) + bit_count(xor(a.hash_lo, b.hash_lo)))::INT AS bits
  FROM photos a JOIN photos b ON b.photo_id = a.photo_id + 5"""))
def hash_distance(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.functions.hashes import hamming

    a = photos(spark, sf).select("photo_id", "hash_hi", "hash_lo")
    b = a.select(F.col("photo_id").alias("other_id"), F.col("hash_hi").alias("o_hi"), F.col("hash_lo").alias("o_lo"))
    return a.join(b, F.col("other_id") == F.col("photo_id") + 5).select(
        "photo_id", "other_id", hamming(F.col("hash_hi"), F.col("hash_lo"), F.col("o_hi"), F.col("o_lo")).alias("bits")
    )


@query("OPS-13", sql=with_(PHOTOS, body="SELECT slot AS vec_id, hash_hi, hash_lo FROM hashes"))
def median_bit_hash(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.functions.hashes import median_bits
    from albumloom.plans.views import table

    return table(spark, sf, "embeddings").select("vec_id", median_bits(F.col("embedding")).alias("h")).select("vec_id", "h.*")


@query("OPS-13", sql="""WITH px AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)) AS e FROM embeddings),
terms AS (SELECT vec_id, k, sum(cos(pi() * k * (2 * i + 1) / 64) * e[i + 1]) AS a, sum(cos(pi() * k * (2 * i + 1) / 64) * e[i + 33]) AS b FROM px, range(8) f(k), range(32) s(i) GROUP BY ALL),
low AS (SELECT x.vec_id, (x.k * 8 + y.k)::INT AS bit, x.a * y.b AS v FROM terms x JOIN terms y USING (vec_id)),
cut AS (SELECT vec_id, median(v) AS m FROM low GROUP BY vec_id)
SELECT vec_id AS photo_id, sum(CASE WHEN bit < 32 AND v > m THEN 1::BIGINT << (bit % 32) ELSE 0 END)::BIGINT AS hash_hi, sum(CASE WHEN bit >= 32 AND v > m THEN 1::BIGINT << (bit % 32) ELSE 0 END)::BIGINT AS hash_lo FROM low JOIN cut USING (vec_id) GROUP BY vec_id""")
def cosine_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of 32 x 32 out of both halves of a vector, as products, so that SQL can sum rows and columns apart."""
    from albumloom.operators.imagehash import dct_hashes
    from albumloom.plans.views import table

    e = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000))
    halves = table(spark, sf, "embeddings").select(F.col("vec_id").alias("photo_id"), F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"))
    luma = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: x * y)))
    return dct_hashes(halves.select("photo_id", luma.alias("luma")))


@query("JOIN-1", sql=with_(PHOTOS, NODES, MATCHES, body="""SELECT a AS photo_id, least(a, min(b)) AS first_match, greatest(a, max(b)) AS last_match FROM matches GROUP BY a"""))
def near_duplicate_reach(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_reach(photos(spark, sf))


@query("AGG-1", sql=with_(PHOTOS, NODES, MATCHES, GROUPS, body="SELECT photo_id, group_id FROM grouped", recursive=True))
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_groups(photos(spark, sf)).select("photo_id", "group_id")


#: distances beside the one that is set, and the queries' matches at them
RADII = (1, 3, 6)


def matches_sql(bits: int, name: str) -> str:
    return MATCHES.replace("matches AS", f"{name} AS").replace("<= 2", f"<= {bits}")


NEAR_SQL = "SELECT 'near' AS what, {bits} AS bits, a AS photo_id, least(a, min(b)) AS low, greatest(a, max(b)) AS high FROM m{bits} GROUP BY a"
GROUP_SQL = """SELECT 'group', {bits}, id, min(grp), NULL::BIGINT FROM w{bits} GROUP BY id"""
WALK_SQL = "w{bits}(id, grp) AS (SELECT photo_id, photo_id FROM photos UNION SELECT m.b, w.grp FROM w{bits} w JOIN m{bits} m ON m.a = w.id WHERE w.grp < m.b)"


@query("JOIN-1", "AGG-1", sql=with_(PHOTOS, NODES, *[matches_sql(r, f"m{r}") for r in RADII], *[WALK_SQL.format(bits=r) for r in RADII], recursive=True,
                                    body=" UNION ALL ".join(q.format(bits=r) for r in RADII for q in (NEAR_SQL, GROUP_SQL))))
def duplicates_by_radius(spark: SparkSession, sf: str) -> DataFrame:
    """Reach and groups of near duplicates at other distances than the one that is set."""
    ph = settle(photos(spark, sf))
    out = found = None
    for bits in RADII:
        p = Chunking(dup_max_bits=bits)
        found = duplicates.matches(ph, p, like=found)
        near = duplicates.duplicate_reach(ph, p, found).select(F.lit("near").alias("what"), F.lit(bits).alias("bits"), "photo_id", F.col("first_match").alias("low"), F.col("last_match").alias("high"))
        group = duplicates.duplicate_groups(ph, p, found).select(F.lit("group").alias("what"), F.lit(bits).alias("bits"), "photo_id", F.col("group_id").alias("low"), F.lit(None).cast("bigint").alias("high"))
        both = near.unionByName(group)
        out = both if out is None else out.unionByName(both)
    return out


@query("WIN-2", sql=with_(PHOTOS, NODES, MATCHES, GROUPS, body="""SELECT g.photo_id, k.photo_id AS kept_id, k.path AS kept_file, 'dup_of:' || k.filename AS reason
  FROM grouped g JOIN kept k USING (group_id) WHERE g.photo_id <> k.photo_id""", recursive=True))
def duplicate_keepers(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.dropped(duplicates.duplicate_groups(photos(spark, sf))).select("photo_id", "kept_id", "kept_file", "reason")


@query("WIN-1", sql=with_(PHOTOS, all_photos(), *stage_sql(Chunking())[:2], body="SELECT photo_id, day::VARCHAR AS day, segment FROM segmented"))
def time_hash_segments(spark: SparkSession, sf: str) -> DataFrame:
    p = photos(spark, sf)
    marks = segments.segment_marks(p).select("day", "t", "segment")
    return p.select("photo_id", "day", "t").join(marks, ["day", "t"]).select("photo_id", F.col("day").cast("string").alias("day"), "segment")


@query("WIN-3", sql=with_(PHOTOS, all_photos(), *stage_sql(Chunking())[:3], body="SELECT day::VARCHAR AS day, segment, start_t, end_t, n, hash_hi, hash_lo FROM segs"))
def segment_representative(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segments(segments.segment_marks(photos(spark, sf))).withColumn("day", F.col("day").cast("string"))


@query("JOIN-2", sql=with_(PHOTOS, all_photos(), *stage_sql(WIDE)[:4], body='SELECT day::VARCHAR AS day, "first", "second" FROM pairs'))
def similar_segment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    segs = segments.segments(segments.segment_marks(photos(spark, sf), WIDE))
    return segments.similar_segments(segs, WIDE).withColumn("day", F.col("day").cast("string"))


@query("AGG-2", sql=with_(PHOTOS, all_photos(), *stage_sql(WIDE), recursive=True, body="""SELECT photo_id, s.day::VARCHAR AS day, s.segment, event
  FROM segmented s JOIN seg_event USING (day, segment)"""))
def merged_segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments.with_events(photos(spark, sf), WIDE).select("photo_id", F.col("day").cast("string").alias("day"), "segment", "event")


@query("AGG-4", sql=with_(PHOTOS, all_photos(), *stage_sql(Chunking())[:1], body=f"""SELECT b.bin, count(d) AS n,
    CASE WHEN (sum(count(d)) OVER ()) = 0 THEN 0.0::DOUBLE ELSE round(count(d) * 100.0::DOUBLE / (sum(count(d)) OVER ())::DOUBLE, 4) END AS pct
  FROM (VALUES ('0-5', 0, 5), ('6-10', 6, 10), ('11-15', 11, 15), ('16-20', 16, 20), ('21-25', 21, 25), ('26-30', 26, 30), ('31-40', 31, 40), ('41-64', 41, 64)) b(bin, lo, hi)
  LEFT JOIN (SELECT {DIST} AS d FROM ordered WHERE t - pt BETWEEN 90 AND 1800 AND a_hi IS NOT NULL AND b_hi IS NOT NULL) ON d BETWEEN lo AND hi GROUP BY b.bin"""))
def distance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.operators.stats import histogram

    return histogram(segments.middle_gaps(photos(spark, sf)), F.col("dist"))


@query("AGG-5", sql=with_(PHOTOS, body="SELECT count(*) AS n, count(lat) AS with_gps, round(count(lat) * 100.0::DOUBLE / greatest(count(*), 1), 4) AS pct FROM photos"))
def gps_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return photos(spark, sf).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("lat").isNotNull()).alias("with_gps"),
        F.round(F.count_if(F.col("lat").isNotNull()) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4).alias("pct"),
    )


def batched(spark: SparkSession, sf: str, p: Chunking, dedup: bool = False) -> DataFrame:
    """Filter, optional duplicate removal, events, batches."""
    return batches.plan_batches(photos(spark, sf), p, drop_copies=dedup)


# splitting and folding as recursive SQL over one row per photo or piece
EVT = """evt AS (
  SELECT s.*, e.event, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY day, event) AS size,
         bit_count(xor(lag(hash_hi) OVER w, hash_hi)) + bit_count(xor(lag(hash_lo) OVER w, hash_lo))
           + least((t - lag(t) OVER w) / 60.0::DOUBLE, 10.0::DOUBLE) AS score
  FROM segmented s JOIN seg_event e USING (day, segment) WINDOW w AS (PARTITION BY day, event ORDER BY t, photo_id))"""
SPLIT = EVT + """,
pieces(day, event, s, e) AS (
  SELECT day, event, 0::BIGINT, max(size)::BIGINT FROM evt GROUP BY day, event
  UNION ALL
  SELECT c.day, c.event, CASE h.half WHEN 0 THEN c.s ELSE c.cut END, CASE h.half WHEN 0 THEN c.cut ELSE c.e END
  FROM (SELECT p.day, p.event, p.s, p.e, coalesce(arg_min(v.pos, (-v.score, v.pos)), p.s + (p.e - p.s) // 2)::BIGINT AS cut
        FROM pieces p LEFT JOIN evt v ON v.day = p.day AND v.event = p.event AND v.score IS NOT NULL AND v.pos BETWEEN p.s + 2 AND p.e - 2
        WHERE p.e - p.s > 10 GROUP BY p.day, p.event, p.s, p.e) c, (VALUES (0), (1)) h(half)),
leaf AS (SELECT * FROM pieces WHERE e - s <= 10),
cutrows AS (SELECT v.*, l.s AS start FROM evt v JOIN leaf l ON v.day = l.day AND v.event = l.event AND v.pos >= l.s AND v.pos < l.e)"""
FOLD = """bats AS (
  SELECT day, event, start, count(*) AS size, min(t) AS first_t, max(t) AS last_t,
         row_number() OVER (PARTITION BY day ORDER BY event, start) AS k FROM cutrows GROUP BY day, event, start),
fold(day, k, held, last_t, batch_no) AS (
  SELECT day, k, size, last_t, 0::BIGINT FROM bats WHERE k = 1
  UNION ALL
  SELECT b.day, b.k, CASE WHEN j THEN held + size ELSE size END, b.last_t, CASE WHEN j THEN batch_no ELSE batch_no + 1 END
  FROM (SELECT b.*, f.held, f.batch_no, (f.held <= 3 AND b.size <= 3 AND f.held + b.size <= 10 AND b.first_t - f.last_t <= 480) AS j
        FROM fold f JOIN bats b ON b.day = f.day AND b.k = f.k + 1) b),
numbered AS (SELECT b.day, b.event, b.start, f.batch_no FROM bats b JOIN fold f USING (day, k)),
final AS (SELECT c.*, n.batch_no, c.day || '_' || CASE WHEN n.batch_no < 1000 THEN lpad(n.batch_no::VARCHAR, 3, '0') ELSE n.batch_no::VARCHAR END AS batch_id
  FROM cutrows c JOIN numbered n USING (day, event, start))"""
UNTRASHED = all_photos(f"WHERE ({TRASH_SQL}) IS NULL")
# events long enough to be split on the given tables
LONG = Chunking(segment_max_bits=40, merge_max_bits=24)


@query("WIN-4", sql=with_(PHOTOS, UNTRASHED, *stage_sql(LONG), EVT, recursive=True, body="""SELECT day::VARCHAR AS day, event, max(size)::BIGINT AS size,
    (coalesce(arg_min(pos, (-score, pos)) FILTER (score IS NOT NULL AND pos BETWEEN 2 AND size - 2), max(size) // 2) - 1)::BIGINT AS last_left
  FROM evt WHERE size > 10 GROUP BY day, event"""))
def best_split(spark: SparkSession, sf: str) -> DataFrame:
    ph = segments.with_events(photos(spark, sf).where(duplicates.is_trash().isNull()), LONG)
    return batches.best_splits(ph, LONG).withColumn("day", F.col("day").cast("string"))


@query("OPS-1", sql=with_(PHOTOS, UNTRASHED, *stage_sql(LONG), SPLIT, recursive=True, body="SELECT photo_id, day::VARCHAR AS day, event, start FROM cutrows"))
def oversize_split(spark: SparkSession, sf: str) -> DataFrame:
    ph = settle(segments.with_events(photos(spark, sf).where(duplicates.is_trash().isNull()), LONG))
    return batches.split_events(ph, LONG).select("photo_id", F.col("day").cast("string").alias("day"), "event", "start")


@query("OPS-2", "WIN-5", sql=with_(PHOTOS, UNTRASHED, *stage_sql(LONG), SPLIT, FOLD, recursive=True, body="SELECT photo_id, batch_id, batch_no, event FROM final"))
def small_batch_merge(spark: SparkSession, sf: str) -> DataFrame:
    return batched(spark, sf, LONG).select("photo_id", "batch_id", "batch_no", "event")


@query("AGG-3", sql=with_(PHOTOS, UNTRASHED, *stage_sql(LONG), SPLIT, FOLD, recursive=True, body="""SELECT size, count(*) AS batches,
    (sum(count(*)) OVER ())::BIGINT AS all_batches, min(size) OVER () AS min_size, max(size) OVER () AS max_size, round((sum(size * count(*)) OVER ())::DOUBLE / (sum(count(*)) OVER ())::DOUBLE, 4) AS avg_size
  FROM (SELECT day, batch_no, count(*) AS size FROM final GROUP BY day, batch_no) GROUP BY size"""))
def batch_statistics(spark: SparkSession, sf: str) -> DataFrame:
    from albumloom.operators.stats import batch_sizes

    return batch_sizes(batched(spark, sf, LONG))


@query("WIN-5", sql=with_(PHOTOS, UNTRASHED, *stage_sql(LONG), SPLIT, FOLD, recursive=True, body=r"""SELECT photo_id, batch_id, CASE WHEN again = 1 THEN short
     ELSE regexp_replace(short, '(\.[^.]*)$', '#' || again || '\1') END AS item_id
  FROM (SELECT photo_id, batch_id, short, row_number() OVER (PARTITION BY day, batch_no, short ORDER BY event, start, t, photo_id) AS again
        FROM (SELECT *, 'IMG_' || (photo_id % 3) || '.jpg' AS short FROM final))"""))
def batch_item_ids(spark: SparkSession, sf: str) -> DataFrame:
    b = batched(spark, sf, LONG).withColumn("filename", F.concat(F.lit("IMG_"), F.col("photo_id") % 3, F.lit(".jpg")))
    return batches.in_batch_ids(b).select("photo_id", "batch_id", "item_id")


FULL = [
    PHOTOS,
    f"clean AS (SELECT * FROM photos WHERE ({TRASH_SQL}) IS NULL)",
    NODES.replace("FROM photos", "FROM clean"),
    MATCHES,
    GROUPS.replace("FROM photos", "FROM clean"),
    "photos_in AS (SELECT * FROM kept)",
    *stage_sql(Chunking()),
    SPLIT,
    FOLD,
]


@query("OPS-3", sql=with_(*FULL, recursive=True, body="SELECT photo_id, batch_id, filename, event, segment FROM final"))
def photo_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batched(spark, sf, Chunking(), dedup=True).select("photo_id", "batch_id", "filename", "event", "segment")


NO_PHOTO = "NULL::VARCHAR AS batch_id, NULL::VARCHAR AS date"
NO_ROW = "NULL::VARCHAR AS filename, NULL::VARCHAR AS datetime, NULL::BOOLEAN AS is_exact_time, NULL::DOUBLE AS lat, NULL::DOUBLE AS lng"
GONE_SQL = "SELECT g.path, 'dup_of:' || k.filename AS reason, k.path AS kept_file FROM grouped g JOIN kept k USING (group_id) WHERE g.photo_id <> k.photo_id"


DOCUMENT_SQL = with_(*FULL[:6], *stage_sql(LONG), SPLIT, FOLD, f"gone AS ({GONE_SQL})", f"trash AS (SELECT path, {TRASH_SQL} AS reason FROM photos WHERE ({TRASH_SQL}) IS NOT NULL)", recursive=True, body=f"""SELECT 'batches' AS list,
    batch_id, day::VARCHAR AS date, path AS file, filename, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS datetime, is_exact AS is_exact_time, lat, lng, NULL::VARCHAR AS reason, NULL::VARCHAR AS kept_file, NULL::BIGINT AS n FROM final
  UNION ALL SELECT 'trashed', {NO_PHOTO}, path, {NO_ROW}, reason, NULL, NULL FROM trash
  UNION ALL SELECT 'deduped', {NO_PHOTO}, path, {NO_ROW}, reason, kept_file, NULL FROM gone
  UNION ALL SELECT 'summary', {NO_PHOTO}, key, {NO_ROW}, NULL, NULL, n FROM (
    SELECT 'total_scanned' AS key, count(*) AS n FROM photos UNION ALL SELECT 'kept', count(*) FROM final UNION ALL SELECT 'trashed', count(*) FROM trash
    UNION ALL SELECT 'deduped', count(*) FROM gone UNION ALL SELECT 'batch_count', count(DISTINCT batch_id) FROM final)""")


@query("SNK-1", "SRC-6", sql=DOCUMENT_SQL)
def batch_document(spark: SparkSession, sf: str) -> DataFrame:
    """The whole document, copies dropped: photos in batches, trashed and duplicate files, totals, each as read back."""
    return document_lists(photos(spark, sf))


@query("SNK-1", "SRC-6", sql=DOCUMENT_SQL)
def batch_document_lists(spark: SparkSession, sf: str) -> DataFrame:
    """``batch_document`` under the name that the whole query had before."""
    return batch_document(spark, sf)


@query("SNK-1", sql=with_(*FULL[:6], *stage_sql(LONG), SPLIT, FOLD, f"gone AS ({GONE_SQL})", f"trash AS (SELECT path FROM photos WHERE ({TRASH_SQL}) IS NOT NULL)",
  "marks AS (SELECT ('0x' || substr(md5(path || '|' || t || '|' || size_bytes), 1, 15))::BIGINT AS v FROM photos)", recursive=True, body="""SELECT 'summary' AS part, field, n::VARCHAR AS value FROM (
    SELECT 'total_scanned' AS field, count(*) AS n FROM photos UNION ALL SELECT 'kept', count(*) FROM final UNION ALL SELECT 'trashed', count(*) FROM trash
    UNION ALL SELECT 'deduped', count(*) FROM gone UNION ALL SELECT 'batch_count', count(DISTINCT batch_id) FROM final)
  UNION ALL SELECT 'source_dir_snapshot', field, n::VARCHAR FROM (SELECT 'file_count' AS field, count(*) AS n FROM marks UNION ALL SELECT 'mix', bit_xor(v) FROM marks UNION ALL SELECT 'mark', sum(v % 1000000007) FROM marks)
  UNION ALL SELECT 'params', field, value FROM (VALUES ('min_size_bytes', '30720'), ('min_side_px', '400'), ('max_aspect', '3.0'), ('dup_max_bits', '2'), ('burst_seconds', '90'), ('hard_cut_seconds', '1800'),
    ('segment_max_bits', '40'), ('merge_max_bits', '24'), ('merge_span_seconds', '3600'), ('max_batch', '10'), ('small_batch', '3'), ('small_gap_seconds', '480')) p(field, value)"""))
def batch_document_header(spark: SparkSession, sf: str) -> DataFrame:
    """Run parameters, totals and source snapshot of the document, as read back."""
    from albumloom.sources import sinks

    return sinks.read_header(spark, f"{written_document(photos(spark, sf))}/header")


def written_document(ph: DataFrame) -> str:
    """Folder of the whole document."""
    from albumloom.operators import files
    from albumloom.sources import sinks
    from albumloom.streaming.runtime import scratch

    spark = ph.sparkSession
    ph = settle(ph)  # each list and total reads it
    reason = duplicates.is_trash(LONG)
    grouped = settle(duplicates.duplicate_groups(ph.where(reason.isNull()), LONG))
    copies = duplicates.dropped(grouped).select("path", "reason", "kept_file")
    kept = settle(batches.plan_batches(ph, LONG, drop_copies=True, grouped=grouped))
    rows = sinks.batch_rows(kept)
    trashed = ph.withColumn("reason", reason).where("reason IS NOT NULL").select("path", "reason")
    copies = settle(copies)
    out = scratch(spark, "document")
    totals = settle(sinks.document_summary(ph, kept, trashed, copies, rows))
    source = files.snapshot(ph.select("path", F.col("t").alias("mtime"), F.col("size_bytes").alias("size")))
    sinks.write_batch_document(out, rows, trashed, copies, totals, sinks.document_header(LONG, totals, source))
    return out


def document_lists(ph: DataFrame) -> DataFrame:
    from albumloom.sources import sinks

    spark, out = ph.sparkSession, written_document(ph)
    listed = sinks.read_batch_document(spark, f"{out}/batches").select(
        F.lit("batches").alias("list"), "batch_id", "date", "file", "filename", "datetime", "is_exact_time", F.get("gps", F.lit(0)).alias("lat"), F.get("gps", F.lit(1)).alias("lng")
    )
    gone = [spark.read.parquet(f"{out}/{name}").withColumnRenamed("path", "file").withColumn("list", F.lit(name)) for name in ("trashed", "deduped")]
    totals = spark.read.parquet(f"{out}/summary").unpivot([], ["total_scanned", "kept", "trashed", "deduped", "batch_count"], "file", "n").withColumn("list", F.lit("summary"))
    for df in (gone[1], gone[0], totals):
        listed = listed.unionByName(df, allowMissingColumns=True)
    return listed
