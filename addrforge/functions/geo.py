"""Distances, boxes and distance penalties as native column expressions. Degrees in, kilometres out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Earth's radius, and kilometres of a degree of latitude and of longitude at the equator.
RADIUS_KM, LAT_KM, LON_KM = 6371.0, 110.574, 111.320
WEB_MERCATOR_M = 20037508.34


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    up, along = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(up) * F.sin(up) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(along) * F.sin(along)
    return 2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def box(lat: Column, lon: Column, km) -> dict[str, Column]:
    up = F.lit(km) / LAT_KM
    along = F.lit(km) / (LON_KM * F.greatest(F.lit(1e-4), F.cos(F.radians(lat))))
    return {"lat_min": lat - up, "lat_max": lat + up, "lon_min": lon - along, "lon_max": lon + along}


def nearest_on_segment(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> dict[str, Column]:
    """Closest point of a segment in a plane scaled at the mean latitude, and its distance."""
    scale = F.cos(F.radians((lat + a_lat + b_lat) / 3))
    px, py, bx, by = (lon - a_lon) * scale, lat - a_lat, (b_lon - a_lon) * scale, b_lat - a_lat
    square = bx * bx + by * by
    t = F.when(square < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / F.greatest(square, F.lit(1e-300)))))
    at_lat, at_lon = a_lat + t * (b_lat - a_lat), a_lon + t * (b_lon - a_lon)
    return {"lat": at_lat, "lon": at_lon, "km": haversine(lat, lon, at_lat, at_lon)}


def from_web_mercator(x: Column, y: Column) -> dict[str, Column]:
    lat = F.degrees(2 * F.atan(F.exp(y / WEB_MERCATOR_M * math.pi)) - math.pi / 2)
    return {"lat": lat, "lon": x / WEB_MERCATOR_M * 180}


def distance_penalty(score: Column, km: Column) -> Column:
    """Better scores fade slower with distance; never under 0.1; unchanged without a distance."""
    k = F.when(score >= 0.7, 50.0).when(score >= 0.5, 35.0).otherwise(25.0)
    return F.when(km.isNull(), score).otherwise(F.greatest(F.lit(0.1), score / (1 + km / k)))


def common_prefix(a: Column, b: Column, most: int = 6) -> Column:
    """Length of the common opening, most at most."""
    same = [F.when((F.length(a) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n)) & (F.length(b) >= n), 1).otherwise(0) for n in range(1, most + 1)]
    return sum(same[1:], same[0])


def prefix_bonus(a: Column, b: Column) -> Column:
    return common_prefix(a, b) * 0.02


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Grid cell of a point: an equi-join key for spatial joins."""
    return F.struct(F.floor(lat / degrees).cast("long").alias("y"), F.floor(lon / degrees).cast("long").alias("x"))


def cells_of_box(b: dict[str, Column], degrees: float) -> Column:
    """All grid cells that a box touches."""
    ys = F.sequence(F.floor(b["lat_min"] / degrees).cast("long"), F.floor(b["lat_max"] / degrees).cast("long"))
    xs = F.sequence(F.floor(b["lon_min"] / degrees).cast("long"), F.floor(b["lon_max"] / degrees).cast("long"))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))
