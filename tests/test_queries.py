"""Every query against its SQL on the driver's smallest tables."""

import glob
import os

import pytest

from addrforge.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([r[i] for i in order]) for r in table)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_autocomplete_finds_the_street_asked_for(spark):
    found = QUERIES["autocomplete"](spark, DIR).collect()
    best = {}
    for r in found:
        best.setdefault(r["query_id"], set()).add(r["street_id"])
    exact = [q for q in best if q % 3 == 0]
    assert exact and sum(q in best[q] for q in exact) >= 0.9 * len(exact)


def test_city_of_odd_queries(spark):
    from addrforge.operators.query_city import split_city

    cities = spark.createDataFrame([("Neumünster", 54.07, 9.98), ("Neumarkt", 49.28, 11.46), ("Bad Segeberg", 53.93, 10.3), ("", 0.0, 0.0), (None, 1.0, 1.0)], "city string, latitude double, longitude double")
    asked = {1: ("kampstraße neum", 54.1, 10.0), 2: ("kampstraße neum", None, None), 3: ("weg bad segeberg", 0.0, 0.0), 4: ("neumünster", 54.1, 10.0), 5: (None, 1.0, 1.0), 6: ("", 1.0, 1.0), 7: ("weg NEUMUENSTER", 0.0, 0.0), 8: ("weg ne", 54.1, 10.0)}
    queries = spark.createDataFrame([(k, *v) for k, v in asked.items()], "query_id long, query string, lat double, lon double")
    got = {r[0]: (r[1], r[2]) for r in split_city(queries, cities).collect()}
    assert got == {1: ("kampstraße", "Neumünster"), 2: ("kampstraße", "neumarkt"), 3: ("weg", "bad segeberg"), 4: ("neumünster", None), 5: (None, None), 6: ("", None), 7: ("weg", "neumünster"), 8: ("weg ne", None)}
    assert split_city(queries.limit(0), cities).count() == 0 and split_city(queries, cities.limit(0)).filter("detected_city is not null").count() == 0


def test_openings_of_one_and_two_letters(spark):
    from addrforge.operators import retrieve, streets

    names = ["Am Markt", "Amselweg", "Ahornweg", "Bergweg", "", None]
    rows = spark.createDataFrame([(k, n, "Kiel", "24103", 54.3, 10.1) for k, n in enumerate(names)], "street_id long, name string, city string, postal_code string, latitude double, longitude double")
    asked = spark.createDataFrame([(1, "a", 54.3, 10.1), (2, "Am", None, None), (3, "amse", 54.3, 10.1), (4, "", 54.3, 10.1), (5, None, 54.3, 10.1), (6, "a", 50.0, 10.1)], "query_id long, query string, lat double, lon double")
    got = {(r["query_id"], r["street_id"]) for r in retrieve.prefix_search(asked, streets.derive(rows)).collect()}
    assert {g for g in got if g[0] != 4} == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 1)}


def test_voice_candidates_meet_by_root_and_place(spark):
    from addrforge.operators import validate

    rows = spark.createDataFrame([(1, "Kieler Straße", 54.30, 10.10), (2, "Kieler Weg", 54.31, 10.11), (3, "Kieler Straße", 53.0, 10.1), (4, "Bergweg", 54.3, 10.1), (5, None, 54.3, 10.1)], "street_id long, name string, latitude double, longitude double")
    asked = spark.createDataFrame([(1, "Kiler Straße", 54.3, 10.1), (2, "Kiler Straße", None, None), (3, None, 54.3, 10.1)], "query_id long, street_name string, lat double, lon double")
    got = [(r["query_id"], r["street_id"]) for r in validate.voice_candidates(asked, rows).collect()]
    assert sorted(got) == [(1, 1), (1, 2)] and validate.voice_candidates(asked.limit(0), rows).count() == 0
