"""The searchable street table: derived columns are always computed when it is written, never later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrforge.functions import phonetic, text


def of_name() -> dict[str, Column]:
    """What is derived from a street's name."""
    return {
        "normalized_search": text.normalize_string(F.col("name")),
        "normalized_name": text.normalize_compact(F.col("name")),
        "phonetic_german": phonetic.german_phrase(F.col("name")),
        "phonetic_cologne": phonetic.cologne_phrase(F.col("name")),
        "consonant_key": text.consonant_key(F.col("name")),
        "german_whole": phonetic.german_code(F.col("name")),
        "cologne_whole": phonetic.cologne_code(F.col("name")),
    }


def derive(streets: DataFrame) -> DataFrame:
    """(street_id, name, city, ...) with normalized_search, normalized_name, phonetic_german, phonetic_cologne, consonant_key, city_key."""
    return streets.withColumns(of_name() | {"city_key": text.city_key(F.col("city"))})


def names(streets: DataFrame) -> DataFrame:
    """name, n_streets and what is derived from the name, once for each distinct name."""
    return streets.filter("name is not null").groupBy("name").agg(F.count("*").alias("n_streets")).withColumns(of_name())


def upsert(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order: last writer wins."""
    kept = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("s"))
    return best.select(*key, *(F.col("s")[c].alias(c) for c in kept))


def insert_ignore(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order: later ones are ignored."""
    kept = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("s"))
    return best.select(*key, *(F.col("s")[c].alias(c) for c in kept))


def city_centroids(streets: DataFrame) -> DataFrame:
    return streets.groupBy("city").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count("*").alias("n_streets"))


def modal_city(streets: DataFrame) -> DataFrame:
    """Most frequent non-empty city of each postal code, ties to the first in the alphabet."""
    counted = streets.filter("coalesce(city, '') <> '' and coalesce(postal_code, '') <> ''").groupBy("postal_code", "city").agg(F.count("*").alias("n"))
    return counted.groupBy("postal_code").agg(F.min_by("city", F.struct(-F.col("n"), "city")).alias("city"))


def fill_empty_cities(streets: DataFrame) -> DataFrame:
    """Rows without a city get their postal code's modal one, unless that (name, postal_code, city) exists already."""
    empty = streets.filter("coalesce(city, '') = ''").drop("city")
    filled = empty.join(modal_city(streets), "postal_code")
    taken = streets.filter("coalesce(city, '') <> ''").select("name", "postal_code", "city").distinct()
    return filled.join(taken, ["name", "postal_code", "city"], "left_anti")


def without_empty_twins(streets: DataFrame) -> DataFrame:
    """Rows without a city go if a row with the same name and postal code has one."""
    named = streets.filter("coalesce(city, '') <> ''").select("name", "postal_code").distinct()
    empty = streets.filter("coalesce(city, '') = ''").join(named, ["name", "postal_code"], "left_anti")
    return streets.filter("coalesce(city, '') <> ''").unionByName(empty.select(streets.columns))


def group_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Street rows out of segments: mean of the segments' midpoints by key, and their common box."""
    return segments.groupBy(*keys).agg(
        F.avg((F.col("start_lat") + F.col("end_lat")) / 2).alias("latitude"),
        F.avg((F.col("start_lon") + F.col("end_lon")) / 2).alias("longitude"),
        F.count("*").alias("n_segments"), F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"),
    )
