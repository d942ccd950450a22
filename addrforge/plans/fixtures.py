"""Street, address, segment and query tables derived from the driver's tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_streets": """
SELECT k AS street_id, name, city, postal_code,
       clat + ((k*7919) % 1000) * 1e-4 AS latitude, clon + ((k*104729) % 1000) * 1e-4 AS longitude
FROM (SELECT c_custkey AS k,
  concat(CASE c_custkey % 8 WHEN 0 THEN 'Kieler ' WHEN 1 THEN 'Bahnhof' WHEN 2 THEN 'Haupt' WHEN 3 THEN 'Geibel'
         WHEN 4 THEN 'Albert-Schweitzer-' WHEN 5 THEN 'Am Neuen ' WHEN 6 THEN 'Kloster' ELSE 'Grethen' END,
         CASE WHEN c_custkey % 8 IN (0,4,5)
              THEN CASE CAST(floor(c_custkey / 8.0) AS BIGINT) % 5 WHEN 0 THEN 'Straße' WHEN 1 THEN 'Weg' WHEN 2 THEN 'Platz' WHEN 3 THEN 'Allee' ELSE 'Kamp' END
              ELSE CASE CAST(floor(c_custkey / 8.0) AS BIGINT) % 5 WHEN 0 THEN 'straße' WHEN 1 THEN 'weg' WHEN 2 THEN 'platz' WHEN 3 THEN 'allee' ELSE 'kamp' END END) AS name,
  CASE c_nationkey % 6 WHEN 0 THEN 'Neumünster' WHEN 1 THEN 'Hamburg' WHEN 2 THEN 'Kiel'
       WHEN 3 THEN 'Henstedt-Ulzburg' WHEN 4 THEN 'Berlin' ELSE 'Überlingen' END AS city,
  concat('', 10000 + (c_custkey*37) % 89999) AS postal_code,
  CASE c_nationkey % 6 WHEN 0 THEN 54.05e0 WHEN 1 THEN 53.50e0 WHEN 2 THEN 54.30e0 WHEN 3 THEN 53.75e0 WHEN 4 THEN 52.45e0 ELSE 47.70e0 END AS clat,
  CASE c_nationkey % 6 WHEN 0 THEN 9.95e0 WHEN 1 THEN 9.95e0 WHEN 2 THEN 10.10e0 WHEN 3 THEN 9.95e0 WHEN 4 THEN 13.35e0 ELSE 9.10e0 END AS clon
FROM customer) s
""",
    "v_addresses": """
SELECT min(o_orderkey) AS address_id, street_id, house_number,
       min(latitude) AS latitude, min(longitude) AS longitude
FROM (SELECT o_orderkey, s.street_id,
  concat('', 1 + o_orderkey % 60, CASE o_orderkey % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE '' END) AS house_number,
  s.latitude + ((o_orderkey*31) % 200 - 100) * 1e-5 AS latitude,
  s.longitude + ((o_orderkey*17) % 200 - 100) * 1e-5 AS longitude
FROM orders JOIN v_streets s ON s.street_id = o_custkey) a GROUP BY street_id, house_number
""",
    "v_segments": """
SELECT segment_id, street_id, start_lat, start_lon, end_lat, end_lon,
  least(start_lat,end_lat) AS min_lat, greatest(start_lat,end_lat) AS max_lat,
  least(start_lon,end_lon) AS min_lon, greatest(start_lon,end_lon) AS max_lon
FROM (SELECT o_orderkey AS segment_id, s.street_id,
  s.latitude + ((o_orderkey*13) % 300 - 150) * 1e-5 AS start_lat, s.longitude + ((o_orderkey*29) % 300 - 150) * 1e-5 AS start_lon,
  s.latitude + ((o_orderkey*41) % 300 - 150) * 1e-5 AS end_lat,   s.longitude + ((o_orderkey*53) % 300 - 150) * 1e-5 AS end_lon
FROM orders JOIN v_streets s ON s.street_id = o_custkey) g
""",
    "v_queries": """
SELECT street_id AS query_id,
  CASE street_id % 3 WHEN 0 THEN lower(name) WHEN 1 THEN concat(substring(lower(name),1,2), substring(lower(name),4))
       ELSE concat(lower(name), ' ', lower(city)) END AS query,
  latitude + 1e-3 AS lat, longitude - 1e-3 AS lon
FROM v_streets WHERE street_id % 25 < 3
""",
}

# Rectangles of administrative areas: layer, key, min_lat, max_lat, min_lon, max_lon.
AREAS = [
    ("level8", "Neumünster", 54.05, 54.15, 9.95, 10.05),
    ("level8", "Hamburg", 53.50, 53.60, 9.95, 10.05),
    ("level6", "Kreis Nord", 53.40, 54.50, 9.80, 10.30),
    ("level4", "Berlin", 52.40, 52.60, 13.30, 13.50),
    ("borough", "Altstadt", 53.52, 53.56, 9.97, 10.01),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver or one of VIEWS."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = {t: load(spark, sf_dir, t) for t in ("customer", "orders", "v_streets") if t in text and t != name}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **used)


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AREAS, "layer string, key string, min_lat double, max_lat double, min_lon double, max_lon double")


def with_views(*names: str) -> str:
    """WITH clause of the views that an oracle needs, in order; the caller goes on with a comma or SELECT."""
    need = [n for n in VIEWS if n in names or n == "v_streets"]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
