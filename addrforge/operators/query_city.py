"""Cities named at the end of free-text queries, split off for a whole batch at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.functions import geo, text

#: Words that a city at the end of a query may have.
MOST_WORDS = 3
#: Letters from which a single last word may be the beginning of a city.
LEAST_LETTERS = 3
#: Among cities with that beginning, the nearest counts up to this distance.
NEAR_KM = 80.0

WHOLE, SPELLED, BEGUN = 0, 1, 2


def _named(cities: DataFrame) -> DataFrame:
    """Cities by what may name them: their name, its spelling without marks, and each beginning of that spelling."""
    spelled = text.normalize_compact(F.col("city"))
    begun = F.transform(F.sequence(F.lit(0), F.length(spelled)), lambda n: F.struct(F.lit(BEGUN).alias("kind"), F.substring(spelled, F.lit(1), n).alias("key")))
    own = F.array(F.struct(F.lit(WHOLE).alias("kind"), F.lower("city").alias("key")), F.struct(F.lit(SPELLED).alias("kind"), spelled.alias("key")))
    return cities.filter("city <> ''").select("city", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"), F.explode(F.concat(own, begun)).alias("by")).select("city", "c_lat", "c_lon", "by.*")


def split_city(queries: DataFrame, cities: DataFrame) -> DataFrame:
    """(query_id, query, lat, lon) and (city, latitude, longitude), one row a city -> query_id, street_query, detected_city.

    The longest ending that names a city wins, at least one word being left: by the name itself, else by its
    spelling, else (a single word) as a beginning. Of several cities that begin alike, the nearest within
    NEAR_KM of the query's place is taken, as spelled in the table; without one, the shortest, then the
    alphabetically first, in lower case, as the other kinds are. Queries that name none stay as they are,
    with a null city; so do null, empty and single-word queries. query_id must be unique.
    """
    words = F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != "")
    ends = queries.select("query_id", "lat", "lon", words.alias("words")).filter(F.size("words") > 1)
    ends = ends.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), F.size("words") - 1))).alias("n"))
    ends = ends.withColumn("ending", F.lower(F.array_join(F.slice("words", F.col("n") * -1, F.col("n")), " ")))
    spelled = text.normalize_compact(F.col("ending"))
    begins = F.when((F.col("n") == 1) & (F.length("ending") >= LEAST_LETTERS), spelled)
    keys = F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in ((WHOLE, F.col("ending")), (SPELLED, spelled), (BEGUN, begins))))
    asked = ends.select("query_id", "lat", "lon", "n", F.array_join(F.slice("words", 1, F.size("words") - F.col("n")), " ").alias("street"), F.explode(keys).alias("by"))
    hits = asked.select("query_id", "lat", "lon", "n", "street", "by.*").join(_named(cities), ["kind", "key"])
    km = F.when(F.col("kind") == BEGUN, geo.haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")))
    near = F.coalesce(km <= NEAR_KM, F.lit(False))
    order = F.struct((-F.col("n")).alias("n"), "kind", F.when(near, 0).otherwise(1).alias("far"), F.when(near, km).otherwise(0.0).alias("km"), F.length("city").alias("letters"), F.lower("city").alias("low"), "city")
    best = hits.groupBy("query_id").agg(F.min(F.struct(*(order[c].alias(c) for c in ("n", "kind", "far", "km", "letters", "low", "city")), "street")).alias("best"))
    detected = F.when(F.col("best.far") == 0, F.col("best.city")).otherwise(F.col("best.low"))
    return queries.select("query_id", "query").join(best, "query_id", "left").select("query_id", F.coalesce("best.street", "query").alias("street_query"), detected.alias("detected_city"))
