"""Address tables from CSV files whose headers vary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrforge.functions import geo

# Headers by meaning, in the order they are tried.
HEADERS = {
    "street": ["strasse", "straße", "street", "str", "strassenname", "str_name"],
    "house_number": ["hausnummer", "hnr", "house_number", "housenumber", "nr"],
    "municipality": ["gemeindename", "gemeinde"],
    "city": ["ort", "stadt", "city", "ortsname"],
    "postal_code": ["plz", "postleitzahl", "postal_code", "postcode"],
    "x": ["x", "easting", "lon", "rechtswert"],
    "y": ["y", "northing", "lat", "hochwert"],
    "wkt": ["wkt", "geom", "geometry", "point"],
}


def _first(df: DataFrame, names: list[str]) -> Column:
    """The first of these columns that exists and is not blank in the row, trimmed."""
    by_lower = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{by_lower[n]}`").cast("string")), F.lit("")) for n in names if n in by_lower]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def resolve(raw: DataFrame) -> DataFrame:
    """Rows of any header -> street, house_number, city, postal_code, latitude, longitude (x and y are Web-Mercator metres)."""
    point = _first(raw, HEADERS["wkt"])
    numbers = r"(?i)^\s*(?:POINT\s*\(\s*)?(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)"
    x = F.coalesce(_first(raw, HEADERS["x"]).try_cast("double"), F.regexp_extract(point, numbers, 1).try_cast("double"))
    y = F.coalesce(_first(raw, HEADERS["y"]).try_cast("double"), F.regexp_extract(point, numbers, 2).try_cast("double"))
    at = geo.from_web_mercator(x, y)
    municipality = F.nullif(F.trim(F.split_part(_first(raw, HEADERS["municipality"]), F.lit(","), F.lit(1))), F.lit(""))
    return raw.select(
        _first(raw, HEADERS["street"]).alias("street"), _first(raw, HEADERS["house_number"]).alias("house_number"),
        F.coalesce(municipality, _first(raw, HEADERS["city"]), F.lit("")).alias("city"), _first(raw, HEADERS["postal_code"]).alias("postal_code"),
        at["lat"].alias("latitude"), at["lon"].alias("longitude"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return resolve(spark.read.option("header", True).option("encoding", "UTF-8").csv(path))


def streets_of(rows: DataFrame) -> DataFrame:
    """One street for each (name, postal code, city), letter case aside; its first row by place and number gives coordinates and spelling."""
    keyed = rows.filter("street is not null").withColumns({"k_name": F.lower("street"), "k_postal": F.coalesce("postal_code", F.lit("")), "k_city": F.lower("city")})
    first = keyed.groupBy("k_name", "k_postal", "k_city").agg(F.min_by(F.struct("street", "city", "postal_code", "latitude", "longitude"), F.struct("latitude", "longitude", "street", "house_number")).alias("s"), F.count("*").alias("n_rows"))
    return first.select(F.col("s.street").alias("name"), "s.city", "s.postal_code", "s.latitude", "s.longitude", "n_rows")
