"""Reverse geocoding of query batches: grid cells as join keys, exact distance afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.functions import geo
from addrforge.operators.batch import given_back, sent, settled

#: Kilometres of the ladder of searches, and degrees of the grid cells that each step joins on (a few times its reach).
LADDER, CELLS = (0.1, 1.0, 5.0), (0.004, 0.02, 0.1)
#: Degrees of a grid cell that areas are joined on.
CELL = 0.05
#: Boxes are a little wider than their reach, as their degrees and the distance differ by 0.6 % at most.
SLACK = 1.01


def _cell_for(km: float) -> float:
    return next((c for step, c in zip(LADDER, CELLS, strict=True) if km <= step), km / 50)


def _around(queries: DataFrame, km: float, degrees: float) -> DataFrame:
    b = geo.box(F.col("lat"), F.col("lon"), km * SLACK)
    return queries.select("query_id", "lat", "lon", *(v.alias(f"q_{k}") for k, v in b.items()), F.explode(geo.cells_of_box(b, degrees)).alias("cell"))


def _places(queries: DataFrame) -> DataFrame:
    """One query of each place."""
    return settled(queries.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("query_id").alias("query_id")))


def _given_back(queries: DataFrame, places: DataFrame, found: DataFrame) -> DataFrame:
    return given_back(queries, places.join(found, "query_id").drop("query_id"), ["lat", "lon"])


def nearest_addresses(queries: DataFrame, addresses: DataFrame, km: float = LADDER[0]) -> DataFrame:
    """(query_id, lat, lon) -> the nearest address within km, ties to the smaller id. Queries without a place find nothing."""
    degrees, places = _cell_for(km), _places(queries)
    a = addresses.select("address_id", "street_id", "house_number", "latitude", "longitude", geo.cell(F.col("latitude"), F.col("longitude"), degrees).alias("cell"))
    met = a.join(sent(_around(places, km, degrees)), "cell").filter(F.col("latitude").between(F.col("q_lat_min"), F.col("q_lat_max")) & F.col("longitude").between(F.col("q_lon_min"), F.col("q_lon_max")))
    away = geo.haversine(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    best = met.groupBy("query_id").agg(F.min(F.struct(F.round(away, 9).alias("km"), "address_id", "street_id", "house_number", "latitude", "longitude")).alias("s"))
    found = best.select("query_id", "s.address_id", "s.street_id", "s.house_number", "s.latitude", "s.longitude", "s.km").filter(F.col("km") <= km)
    return _given_back(queries, places, found)


def _segments_within(places: DataFrame, segments: DataFrame, km: float) -> DataFrame:
    """Boxes are compared before any geometry; a pair that meets in several cells is computed in each and counts once."""
    degrees = _cell_for(km)
    own = {"lat_min": F.least("start_lat", "end_lat"), "lat_max": F.greatest("start_lat", "end_lat"), "lon_min": F.least("start_lon", "end_lon"), "lon_max": F.greatest("start_lon", "end_lon")}
    s = segments.select("segment_id", "street_id", "start_lat", "start_lon", "end_lat", "end_lon", F.explode(geo.cells_of_box(own, degrees)).alias("cell"))
    apart = (own["lat_max"] < F.col("q_lat_min")) | (own["lat_min"] > F.col("q_lat_max")) | (own["lon_max"] < F.col("q_lon_min")) | (own["lon_min"] > F.col("q_lon_max"))
    met = s.join(sent(_around(places, km, degrees)), "cell").filter(~apart)
    at = geo.nearest_on_segment(*(F.col(c) for c in ("lat", "lon", "start_lat", "start_lon", "end_lat", "end_lon")))
    best = met.groupBy("query_id").agg(F.min(F.struct(F.round(at["km"], 9).alias("km"), "segment_id", "street_id", at["lat"].alias("at_lat"), at["lon"].alias("at_lon"))).alias("s"))
    return best.select("query_id", "s.segment_id", "s.street_id", "s.at_lat", "s.at_lon", "s.km").filter(F.col("km") <= km)


def nearest_segments(queries: DataFrame, segments: DataFrame, km: float = LADDER[-1]) -> DataFrame:
    """(query_id, lat, lon) -> the nearest segment within km with its closest point, ties to the smaller id.

    What is found within a step of the ladder is the nearest of all; wider steps are asked only for the places left open.
    """
    places = _places(queries)
    left, found = places, None
    for reach in [*(step for step in LADDER if step < km), km]:
        s = settled(_segments_within(left, segments, reach))
        found = s if found is None else found.unionByName(s)
        left = left.join(s.select("query_id"), "query_id", "left_anti")
        if left.isEmpty():
            break
    return _given_back(queries, places, found)


def reverse(queries: DataFrame, addresses: DataFrame, segments: DataFrame) -> DataFrame:
    """The nearest address within the first step of the ladder, else the nearest segment within ever wider steps; level is the step.

    Segments are asked only for the queries that addresses left open. query_id must be unique.
    """
    a = nearest_addresses(queries, addresses)
    answers = a.select("query_id", "address_id", F.lit(None).cast("long").alias("segment_id"), "street_id", "house_number", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "km")
    answers = settled(answers)
    left = queries.select("query_id", "lat", "lon").join(answers.select("query_id"), "query_id", "left_anti")
    s = nearest_segments(left, segments)
    answers = answers.unionByName(s.select("query_id", F.lit(None).cast("long").alias("address_id"), "segment_id", "street_id", F.lit(None).cast("string").alias("house_number"), F.round("at_lat", 6).alias("lat"), F.round("at_lon", 6).alias("lon"), "km"))
    level = F.when(F.col("km") <= LADDER[0], 1).when(F.col("km") <= LADDER[1], 2).when(F.col("km") <= LADDER[2], 3)
    return queries.select("query_id").join(answers, "query_id", "left").select(
        "query_id", F.col("km").isNotNull().alias("exists"), "address_id", "segment_id", "street_id", "house_number", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.round("km", 6).alias("distance_km"), level.alias("level")
    )


def areas_of_points(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, latitude, longitude) in rectangles (layer, key, box): the smallest area of each layer, by grid cell."""
    own = {k: F.col(c) for k, c in (("lat_min", "min_lat"), ("lat_max", "max_lat"), ("lon_min", "min_lon"), ("lon_max", "max_lon"))}
    a = areas.withColumn("size", (F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))).withColumn("cell", F.explode(geo.cells_of_box(own, CELL)))
    p = points.withColumn("cell", geo.cell(F.col("latitude"), F.col("longitude"), CELL))
    hit = p.join(a, "cell").filter(F.col("latitude").between(F.col("min_lat"), F.col("max_lat")) & F.col("longitude").between(F.col("min_lon"), F.col("max_lon")))
    return hit.groupBy("id", "layer").agg(F.min_by("key", F.struct("size", "key")).alias("key"))


def city_of_points(points: DataFrame, areas: DataFrame) -> DataFrame:
    """The city of each point by the ladder of administrative levels 8, 6, 4, 5, 7, then borough and suburb."""
    layers = ["level8", "level6", "level4", "level5", "level7", "borough", "suburb"]
    found = areas_of_points(points, areas).groupBy("id").pivot("layer", layers).agg(F.first("key"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce(*layers).alias("city"))
