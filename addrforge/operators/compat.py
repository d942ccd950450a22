"""Answers in the shapes of two public geocoding contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geojson_features(found: DataFrame) -> DataFrame:
    """Ranked streets -> one GeoJSON feature each (longitude before latitude)."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    properties = F.struct(F.col("street_id").alias("osm_id"), F.col("name"), F.col("city"), F.col("postal_code").alias("postcode"))
    return found.select("query_id", "position", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def geojson_collections(found: DataFrame) -> DataFrame:
    rows = geojson_features(found).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "feature"))).alias("rows"))
    return rows.select("query_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.col("rows.feature"), ","), F.lit("]}")).alias("collection"))


def search_rows(found: DataFrame) -> DataFrame:
    """Ranked streets -> rows with text coordinates and a display name."""
    name = F.concat_ws(", ", "name", F.concat_ws(" ", "postal_code", "city"))
    return found.select("query_id", "position", F.col("latitude").cast("string").alias("lat"), F.col("longitude").cast("string").alias("lon"), name.alias("display_name"))
