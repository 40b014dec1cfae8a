"""SQL twins of the views, for the checking queries."""

from __future__ import annotations

from albumloom.plans.views import POI_KINDS, POI_WORDS


def _texts(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


K = "CAST(json_extract_string(props, '$.k') AS INT)"

HASHES = """hashes AS (
  SELECT vec_id AS slot,
         list_sum(list_transform(embedding[1:32], lambda x, i: CASE WHEN x > cut THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END))::BIGINT AS hash_hi,
         list_sum(list_transform(embedding[33:64], lambda x, i: CASE WHEN x > cut THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END))::BIGINT AS hash_lo
  FROM (SELECT vec_id, embedding, list_sort(embedding)[32] AS cut FROM embeddings))"""

PHOTOS = HASHES + f""", photos AS (
  SELECT p.*, h.hash_hi, h.hash_lo, '/library/u' || owner || '/' || day || '/' || filename AS path FROM (
    SELECT event_id AS photo_id, user_id AS owner, date_diff('second', TIMESTAMP '1970-01-01', ts) AS t, ts::DATE AS day,
           'IMG_' || (event_id // 4) || ['', '_resized', '_1', ' copy'][(event_id % 4 + 1)::INT] || '.jpg' AS filename,
           event_id % 5 <> 0 AS is_exact,
           (floor(value * 1000) * (1 + event_id % 3))::BIGINT AS size_bytes,
           200 + 40 * {K} AS width, (300 + 60 * (event_id % 50))::INT AS height,
           CASE WHEN event_id % 13 <> 0 THEN round(29.5::DOUBLE + (user_id % 20) * 0.0031::DOUBLE, 6) END AS lat,
           CASE WHEN event_id % 13 <> 0 THEN round(106.5::DOUBLE + ({K} % 25) * 0.0027::DOUBLE, 6) END AS lng,
           CASE WHEN event_id % 97 <> 0 THEN (event_id // 4) % (SELECT count(*) FROM embeddings) END AS slot
    FROM events) p LEFT JOIN hashes h USING (slot))"""

CALLS = f"""calls AS (
  SELECT event_id AS call_id, user_id AS run, date_diff('second', TIMESTAMP '1970-01-01', ts) AS t,
         CASE WHEN event_type IN ('view', 'error') THEN 'T1' WHEN event_type IN ('click', 'signup') THEN 'T2' ELSE 'T3' END AS tier,
         event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' THEN ['Error code: 429 - Too Many Requests', 'HTTP 503 Service Unavailable',
              'Insufficient balance: Payment Required', 'Connection reset by peer', 'unexpected token in reply',
              'status 401 unauthorized'][{K} % 6 + 1] END AS message,
         floor(value * 10)::BIGINT AS prompt_tokens, ({K} * 20)::BIGINT AS cached_tokens, ({K} + 5)::BIGINT AS output_tokens
  FROM events)"""

DECISIONS = """decisions AS (
  SELECT doc_id, photo_id, model, CASE WHEN keep THEN 'keep' ELSE 'delete' END AS decision,
         CASE WHEN keep THEN day || '-' || source ELSE '' END AS event_tag,
         CASE WHEN keep THEN '构图清晰，来源' ELSE '画面模糊，来源' END || source
           || CASE WHEN doc_id % 3 = 0 THEN '，人物自然' ELSE '，背景杂乱' END AS reason, day
  FROM (SELECT l.doc_id, 'DOC_' || l.doc_id || '.jpg' AS photo_id, m.model, d.source,
               '2024-02-' || lpad((l.doc_id % 28 + 1)::VARCHAR, 2, '0') AS day,
               CASE m.model WHEN 'A' THEN quality = 1 WHEN 'B' THEN quality = 1 AND toxic = 0 WHEN 'C' THEN toxic = 0 ELSE l.doc_id % 3 = 0 END AS keep
        FROM labels l JOIN documents d USING (doc_id), (VALUES ('A'), ('B'), ('C'), ('D')) m(model)
        WHERE CASE m.model WHEN 'B' THEN l.doc_id % 11 <> 0 WHEN 'C' THEN l.doc_id % 13 <> 0 WHEN 'D' THEN l.doc_id % 7 <> 0 ELSE true END))"""

EVENT_DIRS = """event_dirs AS (
  SELECT day || '-' || event_name AS folder, grp, day, substr(day, 1, 4) AS year, event_name, photo_count FROM (
    SELECT o_orderdate::DATE::VARCHAR AS day, substr(o_orderpriority, 3, 20) AS event_name, c_mktsegment AS grp, count(*) AS photo_count
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL))"""

EVENTS_BY_TAG = EVENT_DIRS + """, events_by_tag AS (
  SELECT folder AS tag, day, year, event_name, sum(photo_count)::BIGINT AS photo_count FROM event_dirs GROUP BY ALL)"""

EVENT_FILES = """event_files AS (
  SELECT o_orderkey, '/archive/' || CASE WHEN o_orderkey % 41 = 0 THEN 'misc' WHEN o_orderkey % 43 = 0 THEN '_FAILED_FOR_MANUAL_REVIEW'
           ELSE o_orderdate::DATE::VARCHAR || '-' || substr(o_orderpriority, 3, 20) END || '/'
         || CASE WHEN o_orderkey % 17 = 0 THEN 'manifest.json' ELSE
              CASE WHEN o_orderkey % 5 = 0 THEN 'raw' || (o_orderkey % 7) || '/' ELSE '' END || 's' || o_orderkey || '/'
              || CASE WHEN o_orderkey % 19 = 0 THEN 'note_' || o_orderkey || '.txt' ELSE 'IMG_' || (o_custkey % 50) || '.JPG' END END AS path
  FROM orders)"""

THEMES = EVENTS_BY_TAG + """, themes AS (
  SELECT CASE WHEN day(day::DATE) = 31 THEN '单次' || tag ELSE event_name || CASE WHEN day(day::DATE) % 7 = 0 THEN '记录' ELSE '主题' END END AS theme, tag, year, photo_count FROM events_by_tag)"""

RENAMES = """renames AS (
  SELECT DISTINCT theme, event_name || '合并' AS merged FROM (SELECT t.theme, e.event_name FROM themes t JOIN events_by_tag e USING (tag))
  WHERE event_name <> 'LOW' AND NOT starts_with(theme, '单次'))"""

GALLERY = """gallery AS (
  SELECT l_orderkey * 10 + l_linenumber AS item_id, l_linenumber AS line, l_partkey AS part, 'IMG_' || l_orderkey || '.jpg' AS name,
         date_diff('second', TIMESTAMP '1970-01-01', l_shipdate) * 1000 AS taken_ms, round(l_extendedprice * 100)::BIGINT AS size
  FROM lineitem)"""

DELETE_LIST = """delete_list AS (
  SELECT 'IMG_' || o_orderkey || '.jpg' AS name,
         CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) END AS epoch,
         round(o_totalprice * 100)::BIGINT AS size
  FROM orders WHERE o_orderstatus = 'F')"""

CHUNKS = f"""chunks AS (
  SELECT event_id, user_id AS task_id, {K} % 18 AS chunk_index, 16 AS total_chunks, floor(value * 10000000)::BIGINT AS bytes,
         ts, date_diff('second', TIMESTAMP '1970-01-01', ts) AS t, event_type
  FROM events)"""

POI = f"""poi AS (
  SELECT s_suppkey AS poi_id, {_texts(POI_WORDS)}[(s_suppkey % {len(POI_WORDS)} + 1)::INT] || s_suppkey AS name,
         CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE {_texts(POI_KINDS)}[(s_suppkey % {len(POI_KINDS)} + 1)::INT] || ';x;y' END AS type,
         round(29.499::DOUBLE + (s_suppkey % 20) * 0.0031::DOUBLE + (s_nationkey % 3) * 0.0002::DOUBLE, 6) AS lat,
         round(106.4995::DOUBLE + (s_suppkey % 25) * 0.0027::DOUBLE + (s_nationkey % 5) * 0.0003::DOUBLE, 6) AS lng
  FROM supplier)"""

ALIASES = """aliases(ordinal, name, block, lat_min, lng_min, lat_max, lng_max) AS (VALUES
  (0, NULL, true, 29.500::DOUBLE, 106.500::DOUBLE, 29.502::DOUBLE, 106.510::DOUBLE),
  (1, '老家', false, 29.512, 106.500, 29.516, 106.530),
  (2, NULL, false, 29.500, 106.500, 29.530, 106.520),
  (3, '江边', false, 29.530, 106.520, 29.545, 106.550),
  (4, '江边公园', true, 29.540, 106.540, 29.560, 106.570),
  (5, '北岸', false, 29.500, 106.560, 29.506, 106.580))"""


def with_(*ctes: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body

POINTS = """points AS (
  SELECT round(lat::DECIMAL(12,6), 4)::DECIMAL(12,4)::VARCHAR || ',' || round(lng::DECIMAL(12,6), 4)::DECIMAL(12,4)::VARCHAR AS coord, count(*) AS photo_count,
         arg_min(lat, photo_id) AS lat, arg_min(lng, photo_id) AS lng FROM photos WHERE lat IS NOT NULL GROUP BY 1)"""
ADMIN = """admin AS (
  SELECT coord, ['重庆市', '四川省', '香港特别行政区', '云南省'][a % 4 + 1] AS province,
    CASE WHEN a % 4 = 0 THEN CASE WHEN b % 2 = 0 THEN '' ELSE '重庆市' END ELSE ['', '成都市', '', '大理市'][a % 4 + 1] END AS city,
    ['两江新区', '渝中区', '大理县', '重庆市', ''][b % 5 + 1] AS district, ['人和街道', '', '南山镇'][b % 3 + 1] AS township
  FROM (SELECT coord, round((lat - 29.5) / 0.0031::DOUBLE)::INT AS a, round((lng - 106.5) / 0.0027::DOUBLE)::INT AS b FROM points)),
known AS (SELECT coord, province, CASE WHEN city = '' AND province IN ('重庆市', '香港特别行政区') THEN province ELSE city END AS city, district, township FROM admin),
admin_names AS (SELECT *, nullif(concat_ws(' ', nullif(city, ''), CASE WHEN district <> '' AND district <> city AND (city = '重庆市' OR regexp_matches(district, '[县旗]$')) THEN district END, nullif(township, '')), '') AS admin FROM known)"""
HITS = """hits AS (
  SELECT coord, CASE WHEN arg_min(block, ordinal) THEN 'block' ELSE 'replace' END AS alias, CASE WHEN NOT arg_min(block, ordinal) THEN arg_min(aliases.name, ordinal) END AS alias_name
  FROM points JOIN aliases ON lat BETWEEN lat_min AND lat_max AND lng BETWEEN lng_min AND lng_max
  WHERE block OR coalesce(aliases.name, '') <> '' GROUP BY coord)"""
METRES = """asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2))) * 12742000"""
NEAR = f"""near AS (
  SELECT * FROM (SELECT coord, poi_id, poi.name, poi.type, {METRES.format(a='points.', b='poi.')} AS dist FROM points, poi WHERE regexp_matches(poi.name, '[\\x{{4e00}}-\\x{{9fff}}]')) WHERE dist <= 500),
scores AS (SELECT *, CASE WHEN dist <= 30 THEN 36 WHEN dist <= 60 THEN 28 WHEN dist <= 100 THEN 18 WHEN dist <= 200 THEN 8 ELSE 0 END
   + CASE split_part(type, ';', 1) WHEN '风景名胜' THEN 50 WHEN '体育休闲服务' THEN 10 WHEN '餐饮服务' THEN 0 WHEN '住宿服务' THEN -15 WHEN '购物服务' THEN -20 WHEN '科教文化服务' THEN -30
       WHEN '公司企业' THEN -30 WHEN '交通设施服务' THEN -50 WHEN '医疗保健服务' THEN -50 WHEN '商务住宅' THEN -100 ELSE -10 END
   + CASE WHEN regexp_matches(name, '5A|4A|博物馆|古镇') THEN 50 ELSE 0 END AS score FROM near)"""
BEST = """best AS (SELECT coord, name AS poi_name FROM (
  SELECT s.*, row_number() OVER (PARTITION BY coord ORDER BY score DESC, dist, poi_id) AS rn FROM scores s JOIN known USING (coord)
  WHERE coord NOT IN (SELECT coord FROM hits) AND score >= CASE WHEN known.city = '重庆市' THEN 65 ELSE 35 END) WHERE rn = 1)"""
RESOLVED = """resolved AS (SELECT p.coord, photo_count, lat, lng, alias,
    CASE WHEN alias = 'replace' THEN alias_name WHEN poi_name IS NOT NULL THEN concat_ws(' ', admin, poi_name) ELSE admin END AS gps_text,
    CASE WHEN alias = 'replace' THEN alias_name ELSE poi_name END AS gps_strong
  FROM points p LEFT JOIN hits USING (coord) LEFT JOIN admin_names USING (coord) LEFT JOIN best USING (coord))"""

SENT = """sent AS (
  SELECT doc_id, 'b' || (doc_id // 10) AS batch_id, (doc_id % 10)::INT AS rank, 'DOC_' || doc_id || '.jpg' AS item_id,
         '/src/' || source || '/' || doc_id || '/IMG_' || (doc_id % 40) || '.jpg' AS path, 1706745600 + (doc_id // 10 % 28) * 86400 + (doc_id % 10) * 601 AS t,
         doc_id % 4 <> 0 AS is_exact, '2024-02-' || lpad((doc_id // 10 % 28 + 1)::VARCHAR, 2, '0') AS day,
         CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '两江新区 公园' END AS place FROM documents)"""
REPLY_ITEMS = """reply_items AS (
  SELECT 'b' || (doc_id // 10) AS batch_id, (row_number() OVER w - 1)::INT AS "at", doc_id, photo_id, decision = 'keep' AS is_highlight, reason, event_tag,
         row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id DESC) AS from_end
  FROM decisions WHERE model = 'A' WINDOW w AS (PARTITION BY doc_id // 10 ORDER BY doc_id)),
answered AS (SELECT * FROM reply_items WHERE doc_id // 10 % 8 <> 6 AND NOT (doc_id // 10 % 8 = 4 AND from_end = 1))"""
ANSWERS = """answers AS (
  SELECT *, substr(md5(item_id), 1, 1) > '7' AS is_highlight, 'r' || substr(md5(item_id), 1, 1) AS reason, '散步' || substr(md5(item_id), 1, 1) AS event_tag,
    CASE WHEN substr(md5('T1' || item_id), 1, 1) NOT IN ('0', '1', '2') THEN 'T1' WHEN substr(md5('T2' || item_id), 1, 1) > '7' THEN 'T2'
         WHEN substr(md5('T3' || item_id), 1, 1) > '3' THEN 'T3' ELSE 'failed' END AS tier FROM sent)"""
NUMBERED = """numbered AS (SELECT *, (rn - 1) // 100 AS chunk, (rn - 1) % 100 + 1 AS number FROM (SELECT *, row_number() OVER (ORDER BY tag) AS rn FROM themes))"""

RUN_LOGS = DECISIONS + """, meta AS (SELECT model, 'run_' || model || '.log' AS file, count(*) AS n, count(*) FILTER (decision = 'delete') AS gone, count(*) FILTER (decision = 'keep') + count(*) FILTER (doc_id % 6 = 0 AND decision = 'delete') AS kept_lines,
   count(*) + count(*) FILTER (doc_id % 6 = 0) AS all_lines FROM decisions GROUP BY model)"""
STAGE_LOGS = f"""stage_logs AS (SELECT user_id AS run, event_id AS at_, {K} AS k, {K} + 20 AS total, least({K} + 20, (event_id % 60)::INT) AS done FROM events)"""
DELETE_ENTRIES = DELETE_LIST + """, entries AS (SELECT name, CASE WHEN key % 8 = 0 THEN -1 ELSE size END AS want_size, CASE WHEN epoch > 0 THEN epoch * 1000 ELSE -1 END AS want_ms FROM (SELECT *, regexp_extract(name, '\\d+')::BIGINT AS key FROM delete_list))"""
LIST_LINES = """list_lines AS (
  SELECT 'list' || o_custkey AS file, o_orderkey AS pos, CASE WHEN m = 0 THEN '' WHEN m = 1 THEN nm || ' no pipe' WHEN m = 2 THEN nm || '|not_a_number' WHEN m = 3 THEN nm || '|4|extra' WHEN m = 4 THEN '  ' || nm || '  |  523  '
     WHEN m = 5 THEN '# note' WHEN m = 6 THEN '  | 77' ELSE nm || '|' || CASE WHEN o_custkey % 3 = 0 THEN floor(o_totalprice * 100000)::BIGINT ELSE floor(o_totalprice)::BIGINT END END AS line
  FROM (SELECT *, o_orderkey % 13 AS m, 'IMG_' || o_orderkey || '.jpg' AS nm FROM orders)
  UNION ALL SELECT DISTINCT 'list' || o_custkey, -1, CASE WHEN o_custkey % 8 = 0 THEN '#MATCH_MODE=DATETIME' ELSE ' #MATCH_MODE=SIZE ' END FROM orders WHERE o_custkey % 4 = 0),
modes AS (SELECT file, CASE WHEN trim(arg_min(line, pos)) = '#MATCH_MODE=DATETIME' THEN 'DATETIME' WHEN trim(arg_min(line, pos)) = '#MATCH_MODE=SIZE' THEN 'SIZE'
    WHEN coalesce(try_cast(CASE WHEN len(string_split(arg_min(line, pos) FILTER (trim(line) <> '' AND NOT starts_with(trim(line), '#') AND contains(line, '|')), '|')) = 2
       THEN trim(string_split(arg_min(line, pos) FILTER (trim(line) <> '' AND NOT starts_with(trim(line), '#') AND contains(line, '|')), '|')[2]) END AS BIGINT), 0) > 1000000000 THEN 'DATETIME' ELSE 'SIZE' END AS mode FROM list_lines GROUP BY file)"""


def copies_sql(wanted: str, mark: str = "''", numbered: bool = True) -> list[str]:
    """Copy plan of ``wanted`` (folder, name, src, ...) against a target that holds equal, other and numbered files."""
    alt = rf"regexp_replace(name, '(\.[^.]*)$', '_' || {mark} || substr(md5(src), 1, 8) || '\1')"
    return [
        rf"files AS (SELECT DISTINCT *, {alt} AS alt, (length(src) % 4)::VARCHAR || md5(right(regexp_replace(src, '\.[^.]*$', ''), 1)) AS c, substr(md5(src), 1, 1) AS digit FROM {wanted})",
        r"""target AS (SELECT folder, name, arg_max(c, src) AS tc FROM files WHERE substr(md5(folder || name), 1, 1) < '5' GROUP BY ALL
  UNION ALL SELECT folder, alt, CASE WHEN digit < '2' THEN c ELSE 'other' END FROM files WHERE digit < '5'
  UNION ALL SELECT folder, regexp_replace(alt, '(\.[^.]*)$', '_2\1'), CASE WHEN digit = '4' THEN c ELSE 'other' END FROM files WHERE digit IN ('3', '4'))""",
        rf"""copies AS (SELECT * EXCLUDE (hc, hold, tc2), CASE WHEN hold THEN name WHEN c = hc THEN name WHEN tc2 IS NULL OR c = tc2 OR NOT {numbered} THEN alt
      ELSE regexp_replace(alt, '(\.[^.]*)$', CASE WHEN digit = '3' THEN '_3' ELSE '_2' END || '\1') END AS final_name,
    CASE WHEN hold THEN 'copied' WHEN c = hc OR c = tc2 THEN 'exists_same' WHEN tc2 IS NULL THEN 'copied_hashed' WHEN NOT {numbered} THEN 'conflict' WHEN digit = '4' THEN 'exists_same' ELSE 'copied_hashed' END AS status
  FROM (SELECT f.*, coalesce(t.tc, first_value(f.c) OVER w) AS hc, t.tc IS NULL AND row_number() OVER w = 1 AS hold, a.tc AS tc2
        FROM files f LEFT JOIN target t ON t.folder = f.folder AND t.name = f.name LEFT JOIN target a ON a.folder = f.folder AND a.name = f.alt WINDOW w AS (PARTITION BY f.folder, f.name ORDER BY f.src)))""",
    ]
