"""Candidate retrieval for batches of street queries. Every stage is an equi-join on a short derived key.

queries: (query_id, query, lat, lon); streets: operators.streets.derive(). Each stage gives
(query_id, street_id, stage, score) and keeps what the query's own limits allow, ties by street_id. Equal queries
are answered once, and names are scored instead of streets: of each name (and place) only the first ids can be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from addrforge.functions import geo, phonetic, similarity, text
from addrforge.operators.batch import blocks, first_ids, first_streets, given_back, settled
from addrforge.operators.streets import names

#: BM25's usual constants, and the least weight of a trigram that most rows have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def prepared(queries: DataFrame) -> DataFrame:
    q = F.col("query")
    return queries.withColumns({"qn": text.normalize_string(q), "qc": text.normalize_compact(q), "titled": text.title_case(q), "q_german": phonetic.german_code(q), "q_cologne": phonetic.cologne_code(q)})


def _street_bonus(name: Column) -> Column:
    return F.when(F.lower(name).rlike("straße|strasse"), 0.02).otherwise(0.0)


def _sound() -> Column:
    return phonetic.phonetic_score(*(F.col(c) for c in ("q_german", "q_cologne", "german_whole", "cologne_whole")))


def _asked(queries: DataFrame, *by: str) -> DataFrame:
    return prepared(queries.select(*by).distinct())


def _answers(queries: DataFrame, groups: DataFrame, limit: int, by: list[str], order: str, stage: str, *more: str) -> DataFrame:
    """The first streets of each distinct query, given back to all queries."""
    found = first_streets(groups, limit, by, F.desc(order))
    return given_back(queries, found.select(*by, "street_id", F.lit(stage).alias("stage"), *more, "score"), by)


def prefix_search(queries: DataFrame, streets: DataFrame, km: float = 35.0, limit: int = 50) -> DataFrame:
    """Names that open with the query, in a box around its place; blocked on the first three letters (on all of a shorter query)."""
    by = ["query", "lat", "lon"]
    q = _asked(queries, "query").withColumn("key", F.substring("qc", 1, 3))
    s = names(streets).withColumn("key", F.explode(F.array_distinct(F.array(*(F.substring("normalized_name", 1, n) for n in (1, 2, 3))))))
    score = F.when(F.col("name").startswith(F.col("titled")), 1.0).otherwise(0.97) + _street_bonus(F.col("name"))
    opened = q.join(s, "key").filter(F.col("normalized_name").startswith(F.col("qc"))).select("query", "name", score.alias("score"))
    b = geo.box(F.col("lat"), F.col("lon"), km)
    found = queries.select(*by).distinct().join(opened, "query").join(first_ids(streets, limit, ["name", "latitude", "longitude"]), "name")
    found = found.filter(F.col("lat").isNull() | (F.col("latitude").between(b["lat_min"], b["lat_max"]) & F.col("longitude").between(b["lon_min"], b["lon_max"])))
    return _answers(queries, found.select(*by, "ids", "score"), limit, by, "score", "A")


def postings(streets: DataFrame) -> DataFrame:
    """(trigram, street_id, tf, n_trigrams) of the compact names."""
    grams = streets.select("street_id", text.trigrams(F.col("normalized_name")).alias("grams"))
    rows = grams.select("street_id", F.size("grams").alias("n_trigrams"), F.explode("grams").alias("trigram"))
    return rows.groupBy("trigram", "street_id", "n_trigrams").agg(F.count("*").alias("tf"))


def _name_bm25(queries: DataFrame, streets: DataFrame) -> DataFrame:
    """query, qc, name, normalized_name, bm25 over the selected trigrams of the query; a name counts as often as streets have it."""
    known = names(streets).select("name", "n_streets", "normalized_name")
    grams = known.select("name", "n_streets", text.trigrams(F.col("normalized_name")).alias("grams"))
    rows = grams.select("name", "n_streets", F.size("grams").alias("n_trigrams"), F.explode("grams").alias("trigram"))
    rows = rows.groupBy("trigram", "name", "n_streets", "n_trigrams").agg(F.count("*").alias("tf"))
    own = grams.filter(F.size("grams") > 0)
    stats = own.agg(F.sum("n_streets").alias("n_docs"), (F.sum(F.size("grams") * F.col("n_streets")) / F.sum("n_streets")).alias("mean_n"))
    df = rows.groupBy("trigram").agg(F.sum("n_streets").alias("df"))
    q = _asked(queries, "query").select("query", "qc")
    asked = q.select("query", F.explode(text.select_trigrams(text.trigrams(F.col("qc")))).alias("trigram"))
    hit = asked.join(rows, "trigram").join(df, "trigram").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_trigrams") / F.col("mean_n")))
    found = hit.groupBy("query", "name").agg(F.round(F.sum(part), 6).alias("bm25"))
    return found.join(q, "query").join(known.select("name", "normalized_name"), "name")


def trigram_bm25(queries: DataFrame, streets: DataFrame, limit: int = 20) -> DataFrame:
    """Streets by BM25 over the selected trigrams of the query; the score falls between 0 and 1, monotone in BM25."""
    found = _name_bm25(queries, streets).select("query", "name", "bm25", F.round(F.col("bm25") / (6 + F.col("bm25")), 6).alias("score"))
    return _answers(queries, found.join(first_ids(streets, limit, ["name"]), "name"), limit, ["query"], "bm25", "B", "bm25")


def fuzzy_trigram(queries: DataFrame, streets: DataFrame, limit: int = 20) -> DataFrame:
    """BM25 candidates within three edits of the query's compact form: 1.0, 0.9, 0.75 or 0.6 by edits, and the bonuses."""
    edits = F.levenshtein(F.col("qc"), F.col("normalized_name"), 3)
    base = F.when(edits == 0, 1.0).when(edits == 1, 0.9).when(edits == 2, 0.75).when(edits == 3, 0.6)
    score = F.round(base + geo.prefix_bonus(F.col("qc"), F.col("normalized_name")), 6)
    found = _name_bm25(queries, streets).select("query", "name", "bm25", score.alias("score"))
    first = first_streets(found.join(first_ids(streets, 150, ["name"]), "name"), 150, ["query"], F.desc("bm25")).filter("score is not null")
    ranked = first.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "street_id"))).filter(F.col("r") <= limit)
    return given_back(queries, ranked.select("query", "street_id", F.lit("G").alias("stage"), "score"), ["query"])


def phonetic_search(queries: DataFrame, streets: DataFrame, limit: int = 100) -> DataFrame:
    """Names that sound alike: equal openings of any of three codes, as a union of equi-joins."""
    codes = {"phonetic_german": phonetic.german_phrase, "phonetic_cologne": phonetic.cologne_phrase, "consonant_key": text.consonant_key}
    q = _asked(queries, "query").select("query", "qc", *(f(F.col("query")).alias(f"q_{c}") for c, f in codes.items()))
    s = names(streets).select("name", "normalized_name", *codes)
    pairs = None
    for code in codes:
        left = q.filter(F.length(f"q_{code}") >= 2).select("query", F.substring(f"q_{code}", 1, 3).alias("key"))
        # a code of two letters opens every longer one: both lengths of key are offered
        right = s.select("name", F.explode(F.array_distinct(F.array(F.substring(code, 1, 2), F.substring(code, 1, 3)))).alias("key"))
        hit = left.join(right, "key").select("query", "name")
        pairs = hit if pairs is None else pairs.unionByName(hit)
    found = pairs.distinct().join(q, "query").join(s, "name")
    exact = (F.col("q_phonetic_german") == F.col("phonetic_german")) | (F.col("q_phonetic_cologne") == F.col("phonetic_cologne"))
    score = F.round(0.5 + 0.3 * F.when(exact, 0.8).otherwise(0.6) + geo.prefix_bonus(F.col("qc"), F.col("normalized_name")), 6)
    found = found.select("query", "name", score.alias("score")).join(first_ids(streets, limit, ["name"]), "name")
    return _answers(queries, found, limit, ["query"], "score", "D")


def levenshtein_join(queries: DataFrame, streets: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, street_id, edits) of all names within most edits of the query's compact form, with the same first letter.

    Distinct spellings are compared; ids then meet in blocks, so that only the result itself has a row for each pair.
    """
    asked = given_back(queries, _asked(queries, "query").select("query", "qc"), ["query"])
    known = streets.select("street_id", "name").join(names(streets).select("name", "normalized_name"), "name")
    key = lambda c: F.substring(c, 1, 1).alias("key")
    q, s = _asked(queries, "query").select("qc", key("qc")).distinct(), names(streets).select("normalized_name", key("normalized_name")).distinct()
    near = q.join(s, "key").filter(F.abs(F.length("qc") - F.length("normalized_name")) <= most)
    near = near.select("qc", "normalized_name", F.levenshtein("qc", "normalized_name", most).alias("edits")).filter("edits >= 0")
    met = near.join(blocks(asked, "qc", "query_id", "query_ids"), "qc").join(blocks(known, "normalized_name", "street_id", "street_ids"), "normalized_name")
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select("query_ids", "street_ids", "edits").repartition(4 * tasks)
    return dealt.select(F.explode("query_ids").alias("query_id"), "street_ids", "edits").select("query_id", F.explode("street_ids").alias("street_id"), "edits")


def typo_patterns(qn: Column) -> Column:
    """The normalised query with one unknown letter at each of its first four places."""
    n = F.least(F.length(qn), F.lit(4))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(qn, F.lit(1), i - 1), F.lit("_"), F.substring(qn, i + 1, F.length(qn))))


def typo_search(queries: DataFrame, streets: DataFrame, limit: int = 80) -> DataFrame:
    """Names that hold the query with one letter unknown among its first four.

    The letters after the fourth must match, so the query's last trigram (from seven letters on) is an equi-join key;
    shorter queries are keyed by their last letter.
    """
    s = names(streets).select("name", "normalized_search", "normalized_name")
    q = _asked(queries, "query").filter(F.length("qn") >= 3).withColumn("patterns", typo_patterns(F.col("qn")))
    width = F.when(F.length("qn") >= 7, 3).otherwise(1)
    q = q.withColumn("key", F.substring(F.col("qn"), F.length("qn") - width + 1, width))
    keys = F.array_distinct(F.concat(text.trigrams(F.col("normalized_search")), F.split(F.col("normalized_search"), "")))
    found = q.join(s.withColumn("key", F.explode(keys)), "key")
    # a three-letter query may have its last letter unknown, and one of four, too
    short = q.filter(F.length("qn") <= 4).join(s.withColumn("key", F.explode(F.array_distinct(F.split("normalized_search", "")))).withColumnRenamed("key", "first"), F.expr("substring(qn, 1, 1) = first")).drop("first")
    every = found.unionByName(short.withColumn("key", F.lit("")), allowMissingColumns=True)
    hit = every.filter(F.exists("patterns", lambda p: F.like(F.col("normalized_search"), F.concat(F.lit("%"), p, F.lit("%")))))
    score = F.round(0.62 + geo.prefix_bonus(F.col("qc"), F.col("normalized_name")), 6)
    rows = hit.select("query", "name", score.alias("score")).distinct().join(first_ids(streets, limit, ["name"]), "name")
    return _answers(queries, rows, limit, ["query"], "score", "C")


#: Second letters that are easily mistaken for each other.
MISTAKEN = ("a", "e", "i", "o")


def broad_search(queries: DataFrame, streets: DataFrame, limit: int = 50) -> DataFrame:
    """Names with the query's first two letters, or its first and a second one easily mistaken, scored by opening, sound and spelling, less with distance."""
    by = ["query", "lat", "lon"]
    first = F.substring("qn", 1, 1)
    openings = F.array(F.substring("qn", 1, 2), *(F.concat(first, F.lit(v)) for v in MISTAKEN))
    q = _asked(queries, "query").filter(F.length("qn") > 0).withColumn("key", F.explode(F.array_distinct(openings)))
    met = q.join(names(streets).withColumn("key", F.substring("normalized_search", 1, 2)), "key")
    # thousands of streets share a name, so the costly scores are computed for names, not for streets
    met = met.select("query", "name", _sound().alias("spoken"), similarity.fuzzy_score(F.col("qn"), F.col("normalized_search")).alias("spelled"), geo.prefix_bonus(F.col("qc"), F.col("normalized_name")).alias("bonus"))
    raw = met.select("query", "name", F.least(F.lit(1.0), 0.4 * (0.4 + F.col("bonus")) + 0.4 * F.col("spoken") + 0.2 * F.col("spelled")).alias("raw"))
    found = queries.select(*by).distinct().join(raw, "query").join(first_ids(streets, limit, ["name", "latitude", "longitude"]), "name")
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    score = F.round(geo.distance_penalty(F.col("raw"), km), 6)
    return _answers(queries, found.select(*by, "ids", score.alias("score")), limit, by, "score", "E")


def best_per_street(*stages: DataFrame) -> DataFrame:
    """All stages' candidates; of a street found twice the best score, ties to the earlier stage."""
    every = None
    for k, s in enumerate(stages):
        s = s.select("query_id", "street_id", "stage", "score").withColumn("stage_order", F.lit(k))
        every = s if every is None else every.unionByName(s)
    best = every.groupBy("query_id", "street_id").agg(F.min_by(F.struct("stage", "score"), F.struct(-F.col("score"), "stage_order")).alias("s"))
    return best.select("query_id", "street_id", "s.stage", "s.score")


def rerank(candidates: DataFrame, queries: DataFrame, streets: DataFrame, limit: int = 10) -> DataFrame:
    """Final order: retrieval, sound and spelling combined, nearby places raised, far ones lowered."""
    own = streets.select("street_id", "name", "city", "postal_code", "latitude", "longitude")
    found = candidates.join(queries, "query_id").join(own, "street_id").join(_asked(queries, "query"), "query").join(names(streets).drop("n_streets"), "name")
    km = F.bround(geo.haversine(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")), 2)
    found = found.withColumn("distance_km", km)
    combined = F.least(F.lit(1.0), 0.55 * F.col("score") + 0.30 * _sound() + 0.15 * similarity.fuzzy_score(F.col("qn"), F.col("normalized_search")))
    found = found.withColumn("c", combined)
    near = F.when(F.col("distance_km") <= 30, F.least(F.lit(1.0), F.col("c") * 1.2)).when(F.col("distance_km") <= 60, F.least(F.lit(1.0), F.col("c") * 1.05)).otherwise(F.col("c"))
    found = found.withColumn("c", near)
    k = F.when(F.col("c") >= 0.7, 30.0).when(F.col("c") >= 0.5, 20.0).otherwise(15.0)
    far = F.when(F.col("distance_km").isNotNull() & (F.col("c") < 0.85), F.greatest(F.lit(0.1), F.col("c") / (1 + F.col("distance_km") / k))).otherwise(F.col("c"))
    found = found.withColumn("c", far)
    score = F.round(F.when(F.lower("name").rlike("straße|strasse"), F.least(F.lit(1.1), F.col("c") + 0.02)).otherwise(F.col("c")), 6)
    found = found.select("query_id", "street_id", "name", "city", "postal_code", "latitude", "longitude", "distance_km", score.alias("match_score"))
    ranked = found.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("match_score"), F.asc_nulls_last("distance_km"), "name", "city", "street_id")))
    return ranked.filter(F.col("position") <= limit)


def autocomplete(queries: DataFrame, streets: DataFrame, limit: int = 10) -> DataFrame:
    """Openings first; queries they leave open go to fuzzy trigrams, then to sound, then to the broad search; one final order.

    Equal queries from one place are asked once. Each wave's candidates (bounded by its limit for each query) are
    settled before the next one, whose plan would hold those of all waves before several times over.
    """
    by, every = ["query", "lat", "lon"], queries
    queries = settled(every.groupBy(*by).agg(F.min("query_id").alias("query_id")))
    a = settled(prefix_search(queries, streets))
    open_after = lambda found, q: q.join(found.select("query_id").distinct(), "query_id", "left_anti")
    rest = open_after(a, queries)
    g = settled(fuzzy_trigram(rest, streets))
    rest = open_after(g, rest)
    d = settled(phonetic_search(rest, streets))
    rest = open_after(d, rest)
    e = settled(broad_search(rest, streets))
    found = rerank(best_per_street(a, g, d, e), queries, streets, limit)
    answers = found.join(queries, "query_id").drop("query_id")
    return given_back(every, answers, by).select(found.columns)
