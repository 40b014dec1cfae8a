"""Coordinates, alias boxes, points of interest and place texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumloom.functions import geo
from albumloom.operators import placing
from albumloom.plans.oracle import ADMIN, ALIASES, BEST, HITS, METRES, NEAR, PHOTOS, POI, POINTS, RESOLVED, with_
from albumloom.params import Placing
from albumloom.plans.registry import query
from albumloom.plans.views import admin_areas, aliases, photos, poi, table


@query("SCL-6", sql="""SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * (d + m / 60.0::DOUBLE + s / 3600.0::DOUBLE), 9) AS degrees
  FROM (SELECT o_orderkey, (o_orderkey % 180)::DOUBLE AS d, (o_orderkey % 60)::DOUBLE AS m, (o_orderkey % 59) * 1.0::DOUBLE + 0.25::DOUBLE AS s FROM orders)""")
def dms_degrees(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("o_orderkey")
    dms = F.array((i % 180).cast("double"), (i % 60).cast("double"), (i % 59) + 0.25)
    ref = F.when(i % 3 == 0, " w ").otherwise("N")
    return table(spark, sf, "orders").select("o_orderkey", F.round(geo.decimal_degrees(dms, ref), 9).alias("degrees"))


@query("FIL-3", sql="""SELECT event_id, CASE WHEN ok THEN round(lat, 6) END AS lat, CASE WHEN ok THEN round(lng, 6) END AS lng FROM (
  SELECT *, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (abs(lat) < 0.001 AND abs(lng) < 0.001) AS ok FROM (
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0005::DOUBLE ELSE value - 100 END AS lat, CASE WHEN event_id % 7 = 0 THEN -0.0002::DOUBLE ELSE value * 2 - 150 END AS lng FROM events))""")
def gps_validity(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.col("event_id") % 7 == 0
    lat = F.when(zero, 0.0005).otherwise(F.col("value") - 100)
    lng = F.when(zero, -0.0002).otherwise(F.col("value") * 2 - 150)
    return table(spark, sf, "events").select("event_id", geo.valid_point(lat, lng).alias("p")).select("event_id", "p.lat", "p.lng")


@query("FIL-4", sql=with_(POI, body="SELECT poi_id, name FROM poi WHERE regexp_matches(name, '[\\x{4e00}-\\x{9fff}]')"))
def chinese_names(spark: SparkSession, sf: str) -> DataFrame:
    return poi(spark, sf).where(F.col("name").rlike(geo.HAS_CHINESE)).select("poi_id", "name")


@query("SCL-7", "AGG-6", sql=with_(PHOTOS, POINTS, body="SELECT coord, photo_count, lat, lng FROM points"))
def grid_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return placing.grid_points(photos(spark, sf))


@query("JOIN-4", sql=with_(PHOTOS, POINTS, body="""SELECT photo_id, points.coord, photo_count FROM photos LEFT JOIN points
  ON points.coord = round(photos.lat::DECIMAL(12,6), 4)::DECIMAL(12,4)::VARCHAR || ',' || round(photos.lng::DECIMAL(12,6), 4)::DECIMAL(12,4)::VARCHAR"""))
def grid_write_back(spark: SparkSession, sf: str) -> DataFrame:
    p = photos(spark, sf)
    return p.withColumn("coord", geo.grid_key(F.col("lat"), F.col("lng"))).join(placing.grid_points(p).select("coord", "photo_count"), "coord", "left").select("photo_id", "coord", "photo_count")


GCJ = """WITH src AS (SELECT event_id, 20 + (event_id % 30) + value / 1000 AS lat, 60 + (event_id % 80) + value / 900 AS lng FROM events),
xy AS (SELECT *, lng - 105.0::DOUBLE AS x, lat - 35.0::DOUBLE AS y, lng > 73.66 AND lng < 135.05 AND lat > 3.86 AND lat < 53.55 AS inside, radians(lat) AS phi FROM src),
sh AS (SELECT *, (20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3 AS xx, 1 - 0.00669342162296594323::DOUBLE * sin(phi) * sin(phi) AS m,
   -100 + 2 * x + 3 * y + 0.2::DOUBLE * y * y + 0.1::DOUBLE * x * y + 0.2::DOUBLE * sqrt(abs(x)) + (20 * sin(y * pi()) + 40 * sin(y / 3 * pi()) + 160 * sin(y / 12 * pi()) + 320 * sin(y / 30 * pi())) * 2 / 3 AS la,
   300 + x + 2 * y + 0.1::DOUBLE * x * x + 0.1::DOUBLE * x * y + 0.1::DOUBLE * sqrt(abs(x)) + (20 * sin(x * pi()) + 40 * sin(x / 3 * pi()) + 150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3 AS lo FROM xy)
SELECT event_id, round(CASE WHEN inside THEN lat + (la + xx) * 180 / (6378245.0::DOUBLE * (1 - 0.00669342162296594323::DOUBLE) / (m * sqrt(m)) * pi()) ELSE lat END, 6) AS lat,
  round(CASE WHEN inside THEN lng + (lo + xx) * 180 / (6378245.0::DOUBLE / sqrt(m) * cos(phi) * pi()) ELSE lng END, 6) AS lng FROM sh"""


@query("SCL-8", sql=GCJ)
def map_offset(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", (20 + i % 30 + F.col("value") / 1000).alias("a"), (60 + i % 80 + F.col("value") / 900).alias("b"))
    lat, lng = geo.map_offset(F.col("a"), F.col("b"))
    return e.select("event_id", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


@query("SCL-11", sql=with_(PHOTOS, POI, body=f"SELECT photo_id, poi_id, round({METRES.format(a='photos.', b='poi.')}, 3) AS metres FROM photos JOIN poi ON poi_id = photo_id % (SELECT count(*) FROM supplier) WHERE photos.lat IS NOT NULL"))
def great_circle(spark: SparkSession, sf: str) -> DataFrame:
    sites = poi(spark, sf)
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n")).scalar()
    p = photos(spark, sf).where("lat IS NOT NULL").select("photo_id", "lat", "lng", (F.col("photo_id") % n).alias("poi_id"))
    q = sites.select("poi_id", F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"))
    return p.join(q, "poi_id").select("photo_id", "poi_id", F.round(geo.haversine(F.col("lat"), F.col("lng"), F.col("q_lat"), F.col("q_lng")), 3).alias("metres"))


@query("JOIN-3", sql=with_(PHOTOS, body="""SELECT p.path, p.photo_id, photo_id % 2 = 0 AND photo_id % 6 <> 0 AS hit, CASE WHEN photo_id % 2 = 0 AND photo_id % 6 <> 0 THEN hash_hi END AS hash FROM photos p"""))
def hash_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = photos(spark, sf)
    stored = p.where("photo_id % 2 = 0").select("path", (F.col("t") + F.when(F.col("photo_id") % 6 == 0, 1.0).otherwise(0.4)).alias("mtime"), F.col("hash_hi").alias("hash"))
    now = p.select("path", "photo_id", F.col("t").cast("double").alias("mtime"))
    return placing.cache_lookup(now, stored).select("path", "photo_id", "hit", "hash")


@query("JOIN-5", sql=with_(PHOTOS, POINTS, ALIASES, HITS, body="SELECT coord, alias, alias_name FROM hits"))
def alias_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return placing.alias_hits(placing.grid_points(photos(spark, sf)), aliases(spark))


@query("JOIN-6", "SCL-12", sql=with_(PHOTOS, POINTS, POI, NEAR, body="SELECT coord, poi_id, round(dist, 3) AS dist, score FROM scores"))
def poi_in_radius(spark: SparkSession, sf: str) -> DataFrame:
    near = placing.nearby_poi(placing.grid_points(photos(spark, sf)), poi(spark, sf))
    return placing.scored(near).select("coord", "poi_id", F.round("dist", 3).alias("dist"), "score")


@query("JOIN-6", "SCL-12", sql=with_(PHOTOS, POINTS, POI, NEAR.replace("dist <= 500)", "dist <= 5000)"), body="SELECT coord, poi_id, round(dist, 3) AS dist, CASE WHEN contains(name, '博物馆') THEN -999 ELSE score END AS score FROM scores"))
def poi_in_wide_radius(spark: SparkSession, sf: str) -> DataFrame:
    """Ten times the set radius, and a name that is not wanted."""
    p = Placing(poi_radius_m=5000.0, poi_blacklist=("博物馆",))
    near = placing.nearby_poi(placing.grid_points(photos(spark, sf)), poi(spark, sf), p)
    return placing.scored(near, p).select("coord", "poi_id", F.round("dist", 3).alias("dist"), "score")


@query("WIN-7", sql=with_(PHOTOS, POINTS, POI, ALIASES, HITS, ADMIN, NEAR, BEST, body="SELECT coord, poi_name FROM best"))
def best_poi(spark: SparkSession, sf: str) -> DataFrame:
    pts = placing.grid_points(photos(spark, sf))
    known = admin_areas(pts).select("coord", geo.city_of(F.col("province"), F.col("city")).alias("city"))
    free = pts.join(placing.alias_hits(pts, aliases(spark)), "coord", "left_anti")
    near = placing.scored(placing.nearby_poi(free, poi(spark, sf))).join(known, "coord")
    return placing.best_poi(near, F.when(F.col("city") == "重庆市", 65).otherwise(35)).select("coord", F.col("name").alias("poi_name"))


@query("WIN-8", sql=with_(PHOTOS, POINTS, POI, NEAR, body="""SELECT coord, string_agg(name || ':' || score, ' ' ORDER BY a) FILTER (a <= 5) AS by_score, string_agg(name, ' ' ORDER BY b) FILTER (b <= 5) AS by_dist
  FROM (SELECT *, row_number() OVER (PARTITION BY coord ORDER BY score DESC, dist, poi_id) AS a, row_number() OVER (PARTITION BY coord ORDER BY dist, poi_id) AS b FROM scores) GROUP BY coord"""))
def top_poi(spark: SparkSession, sf: str) -> DataFrame:
    near = placing.scored(placing.nearby_poi(placing.grid_points(photos(spark, sf)), poi(spark, sf)))
    return placing.top_poi(near).select("coord", ranked("by_score", True).alias("by_score"), ranked("by_dist", False).alias("by_dist"))


def ranked(col: str, with_score: bool):
    def one(x):
        return F.concat(x["name"], F.lit(":"), x["score"].cast("string")) if with_score else x["name"]

    return F.array_join(F.transform(col, one), " ")


@query("SCL-13", "SCL-14", sql=with_(PHOTOS, POINTS, ADMIN, body="SELECT coord, city, coalesce(admin, '') AS admin FROM admin_names"))
def admin_texts(spark: SparkSession, sf: str) -> DataFrame:
    a = admin_areas(placing.grid_points(photos(spark, sf))).withColumn("city", geo.city_of(F.col("province"), F.col("city")))
    return a.select("coord", "city", geo.admin_text(F.col("city"), F.col("district"), F.col("township")).alias("admin"))


FULL = [PHOTOS, POINTS, POI, ALIASES, HITS, ADMIN, NEAR, BEST, RESOLVED]


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    pts = placing.grid_points(photos(spark, sf))
    return placing.resolve_points(pts, poi(spark, sf), admin_areas(pts), aliases(spark))


@query("SCL-15", sql=with_(*FULL, body="SELECT coord, alias, gps_text, gps_strong FROM resolved"))
def place_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select("coord", "alias", "gps_text", "gps_strong")


@query("OPS-4", "SCL-16", sql=with_(*FULL, body="""SELECT photo_id, gps_text, gps_strong,
    CASE WHEN gps_strong <> '' THEN CASE WHEN starts_with(gps_strong, '重庆市') AND trim(substr(gps_strong, 4)) <> '' THEN trim(substr(gps_strong, 4)) ELSE gps_strong END
         WHEN gps_text <> '' AND NOT starts_with(gps_text, '重庆市') THEN gps_text END AS place
  FROM photos LEFT JOIN resolved r ON r.coord = round(photos.lat::DECIMAL(12,6), 4)::DECIMAL(12,4)::VARCHAR || ',' || round(photos.lng::DECIMAL(12,6), 4)::DECIMAL(12,4)::VARCHAR"""))
def photo_places(spark: SparkSession, sf: str) -> DataFrame:
    placed = placing.write_back(photos(spark, sf), resolved(spark, sf))
    return placed.select("photo_id", "gps_text", "gps_strong", geo.place_for_naming(F.col("gps_strong"), F.col("gps_text")).alias("place"))


@query("SNK-6", sql=with_(*FULL, body="""SELECT r.coord, photo_count, gps_text, gps_strong, r.alias, chosen, chosen_score,
    by_score, by_dist FROM resolved r
  LEFT JOIN (SELECT coord, arg_min(name, (-score, dist, poi_id)) FILTER (score >= 35) AS chosen, max(score) FILTER (score >= 35) AS chosen_score FROM scores
             WHERE coord NOT IN (SELECT coord FROM hits) GROUP BY coord) USING (coord)
  LEFT JOIN (SELECT coord, string_agg(name || ':' || score, ' ' ORDER BY a) FILTER (a <= 5) AS by_score, string_agg(name, ' ' ORDER BY b) FILTER (b <= 5) AS by_dist
    FROM (SELECT *, row_number() OVER (PARTITION BY coord ORDER BY score DESC, dist, poi_id) AS a, row_number() OVER (PARTITION BY coord ORDER BY dist, poi_id) AS b
          FROM scores WHERE coord NOT IN (SELECT coord FROM hits WHERE alias = 'replace')) GROUP BY coord) USING (coord)"""))
def geo_review(spark: SparkSession, sf: str) -> DataFrame:
    r = placing.review(resolved(spark, sf), poi(spark, sf))
    return r.select("coord", "photo_count", "gps_text", "gps_strong", "alias", "chosen", "chosen_score", ranked("by_score", True).alias("by_score"), ranked("by_dist", False).alias("by_dist")).orderBy(
        F.desc("photo_count"), "coord"
    )
