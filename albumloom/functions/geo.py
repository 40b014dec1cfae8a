"""Coordinates: validity, grid keys, map offset, distance, point-of-interest scores, place texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumloom.params import Placing


def decimal_degrees(dms: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds -> degrees, negative for S and W; null with fewer than three parts."""
    value = F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60.0 + F.get(dms, F.lit(2)) / 3600.0
    return F.when(F.size(dms) >= 3, F.when(F.upper(F.trim(ref)).isin("S", "W"), -value).otherwise(value))


def valid_point(lat: Column, lng: Column) -> Column:
    """Struct (lat, lng) to six digits; null off the globe or at the 0,0 placeholder."""
    ok = lat.between(-90, 90) & lng.between(-180, 180) & ~((F.abs(lat) < 0.001) & (F.abs(lng) < 0.001))
    return F.when(ok, F.struct(F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng")))


def grid_key(lat: Column, lng: Column) -> Column:
    """Text key to four digits."""
    def four(x: Column) -> Column:
        return F.round(x.cast("decimal(12,6)"), 4).cast("decimal(12,4)").cast("string")

    return F.concat(four(lat), F.lit(","), four(lng))


def map_offset(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Published WGS-84 to GCJ-02 shift: identity outside the box, trigonometric series inside."""
    # fixed values of the published series: ellipsoid, box, coefficients
    a, ee = 6378245.0, 0.00669342162296594323
    x, y = lng - 105.0, lat - 35.0

    def waves(v: Column, terms: list[tuple[float, float]]) -> Column:
        total = F.lit(0.0)
        for size, period in terms:
            total = total + size * F.sin(v * (math.pi / period))
        return total * 2 / 3

    cross, root = x * y * 0.1, F.sqrt(F.abs(x))
    shared = waves(x, [(20.0, 1 / 6), (20.0, 1 / 2)])
    north = -100.0 + x * 2 + y * 3 + y * y * 0.2 + cross + root * 0.2 + shared + waves(y, [(20.0, 1.0), (40.0, 3.0), (160.0, 12.0), (320.0, 30.0)])
    east = 300.0 + x + y * 2 + x * x * 0.1 + cross + root * 0.1 + shared + waves(x, [(20.0, 1.0), (40.0, 3.0), (150.0, 12.0), (300.0, 30.0)])
    phi = F.radians(lat)
    w = 1 - ee * F.pow(F.sin(phi), 2)
    d_lat = F.degrees(north / (a * (1 - ee) / (w * F.sqrt(w))))
    d_lng = F.degrees(east / (a / F.sqrt(w) * F.cos(phi)))
    inside = (lng > 73.66) & (lng < 135.05) & (lat > 3.86) & (lat < 53.55)
    return F.when(inside, lat + d_lat).otherwise(lat), F.when(inside, lng + d_lng).otherwise(lng)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres on a sphere of 6,371,000 m."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    side = F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.asin(F.sqrt(half + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * side)) * (2 * 6371000)


# fixed values: score per distance step, per main category and for strong words
DISTANCE_STEPS = [(30, 36), (60, 28), (100, 18), (200, 8)]
CATEGORY_SCORES = {
    "风景名胜": 50, "体育休闲服务": 10, "餐饮服务": 0, "住宿服务": -15, "购物服务": -20, "金融保险服务": -30,
    "科教文化服务": -30, "政府机构及社会团体": -30, "公司企业": -30, "公共设施": -30, "地名地址信息": -30,
    "交通设施服务": -50, "医疗保健服务": -50, "汽车服务": -50, "通行设施": -50, "商务住宅": -100,
}
OTHER_CATEGORY = -10
STRONG_WORDS = ["5A", "4A", "博物馆", "博物院", "纪念馆", "美术馆", "古镇", "古城", "古村"]
STRONG_BONUS = 50
BLACKLISTED = -999
HAS_CHINESE = "[\\u4e00-\\u9fff]"


def poi_score(name: Column, kind: Column, dist: Column, blacklist: list[str] | None = None) -> Column:
    near = F.when(F.lit(False), 0)
    for limit, score in DISTANCE_STEPS:
        near = near.when(dist <= limit, score)
    main = F.split_part(kind, F.lit(";"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_SCORES.items() for x in kv])
    total = near.otherwise(0) + F.coalesce(table[main], F.lit(OTHER_CATEGORY)) + F.when(name.rlike("|".join(STRONG_WORDS)), STRONG_BONUS).otherwise(0)
    if blacklist:
        return F.when(name.rlike("|".join(blacklist)), BLACKLISTED).otherwise(total)
    return total


# fixed values: provinces that are their own city
OWN_CITY = ["重庆市", "北京市", "上海市", "天津市", "香港特别行政区", "澳门特别行政区"]


def city_of(province: Column, city: Column) -> Column:
    c = F.coalesce(F.trim(city), F.lit(""))
    return F.when((c == "") & province.isin(*OWN_CITY), province).otherwise(c)


def admin_text(city: Column, district: Column, township: Column, p: Placing = Placing()) -> Column:
    """City, district where it tells something, township; empty text when all are missing."""
    named = F.endswith(district, F.lit("县")) | F.endswith(district, F.lit("旗"))
    keep = (F.coalesce(district, F.lit("")) != "") & ~district.eqNullSafe(city) & (city.eqNullSafe(F.lit(p.home_city)) | named)
    return F.concat_ws(" ", F.when(city != "", city), F.when(keep, district), F.when(township != "", township))


def place_for_naming(strong: Column, text: Column, p: Placing = Placing()) -> Column:
    """Place given to the naming step: a strong place without the home prefix, a weak one only away from home."""
    home = F.lit(p.home_city)
    short = F.trim(F.substr(strong, F.lit(len(p.home_city) + 1)))
    strong_text = F.when(F.startswith(strong, home) & (short != ""), short).otherwise(strong)
    return F.when(F.coalesce(strong, F.lit("")) != "", strong_text).when(
        (F.coalesce(text, F.lit("")) != "") & ~F.startswith(text, home), text
    )
