"""Validation of misheard street names: by name, by opening, then by sound near the caller."""

import glob
import os

import pytest
from addrforge.operators import streets, validate
from addrforge.plans.fixtures import load
from addrforge.plans.queries import q_validate_voice

DIR = "/root/testdata/sf0.001"
#: Each street's name as it is, cut, misheard in several ways or none of the kind; with and without city, place and number.
MISHEARD = """SELECT street_id AS query_id, CASE street_id % 9 WHEN 0 THEN name WHEN 1 THEN substring(name, 1, 3) WHEN 2 THEN replace(replace(name, 'hof', 'hohe'), 'Geib', 'Gemb')
  WHEN 3 THEN replace(replace(replace(name, 'Kl', 'Kn'), 'pt', 'st'), 'eth', 'ev') WHEN 4 THEN concat('In der ', replace(replace(name, 'Schw', 'M'), 'Neuen', 'Neumen')) WHEN 5 THEN replace(name, 'eler', 'nder')
  WHEN 6 THEN replace(replace(name, 'Am', 'Im'), 'Bahn', 'Baum') WHEN 7 THEN 'Xylophongasse' ELSE CASE WHEN street_id % 2 = 0 THEN 'Straße' ELSE '' END END AS street_name,
  CASE street_id % 4 WHEN 0 THEN '0' WHEN 1 THEN 'x' ELSE concat('', 1 + (street_id*7) % 60) END AS house_number, CASE street_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Kiel' ELSE city END AS city,
  CASE street_id % 8 WHEN 0 THEN NULL WHEN 1 THEN latitude + 0.3e0 ELSE latitude END AS lat, CASE street_id % 8 WHEN 0 THEN NULL ELSE longitude END AS lon FROM v_streets"""


def test_misheard_names_against_the_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = load(spark, DIR, "v_streets")
    asked = spark.sql(MISHEARD.replace("FROM v_streets", "FROM {v}"), v=found)
    got = validate.validate(asked, streets.derive(found), load(spark, DIR, "v_addresses"), voice=True)
    want = con.execute(q_validate_voice(MISHEARD))
    assert got.columns == [c[0] for c in want.description]
    rows, same = sorted(map(tuple, got.collect())), sorted(want.fetchall())
    assert list(map(repr, rows)) == list(map(repr, same))
    kinds = {(r[10], r[2]) for r in rows}
    assert kinds >= {("exact", 2), ("exact", 3), ("phonetic_voice", 2), ("phonetic_voice", 3), (None, None)}, kinds


@pytest.fixture(scope="module")
def town(spark):
    names = {1: ("Boostedter Straße", "Neumünster", 54.07, 9.98), 2: ("Boostedter Weg", "Neumünster", 54.10, 9.98), 3: ("In der Heide", "Kiel", 54.07, 9.99), 4: ("Buschallee", "Kiel", 54.0701, 9.98), 5: ("Boostedter Straße", "Berlin", 52.5, 13.4)}
    names |= {k: ("Roonstraße", "Kiel", 54.07 + (k - 10) * 1e-3, 9.98) for k in range(10, 25)}
    rows = spark.createDataFrame([(k, n, c, "24534", y, x) for k, (n, c, y, x) in names.items()], "street_id long, name string, city string, postal_code string, latitude double, longitude double")
    numbers = [(100 + k, k, n, names[k][2], names[k][3]) for k, n in [(1, "12"), (2, "12"), (4, "12"), (5, "12"), *((k, str(k)) for k in range(10, 25))]]
    return streets.derive(rows), spark.createDataFrame(numbers, "address_id long, street_id long, house_number string, latitude double, longitude double")


def test_each_step_of_the_method(spark, town):
    asked = {
        1: ("Buschlederstraße", "12", None, 54.07, 9.98),  # heard: no name opens so
        2: ("Boosted", "12", "Neumünster", 54.07, 9.98),  # opens a name
        3: ("Boostedter Weg", "12", None, 52.5, 13.4),  # the name itself is far; heard is the street of the same root nearby
        4: ("Buschlederstraße", "12", None, None, None),  # no place, no scan
        5: ("Buschlederstraße", "12", "Kiel", 54.07, 9.98),  # the city's streets only
        6: ("Boostedter Straße", "0", "Neumünster", 54.07, 9.98),  # the street itself
        7: ("In der Heihmde", "5", None, 54.07, 9.98),  # a name with the first letter of the spoken one, or of its root
        8: ("Rohnweg", "24", "Kiel", 54.07, 9.98),  # of the ten best and nearest, the nearest number
        9: (None, "1", None, 54.07, 9.98),
        10: ("Heideweg", "5", None, 54.07, 9.98),  # no name opens so, and none with its letter is near
    }
    q = spark.createDataFrame([(k, *v) for k, v in asked.items()], "query_id long, street_name string, house_number string, city string, lat double, lon double")
    got = {r["query_id"]: r for r in validate.validate(q, *town, voice=True).collect()}
    short = {k: (r["exists"], r["street_id"], r["house_number"], r["match_type"], r["confidence"] is not None) for k, r in got.items()}
    assert short[1] == (True, 1, "12", "phonetic_voice", True) and 0.65 <= got[1]["confidence"] < 1
    assert short[2] == (True, 1, "12", "exact", False) and short[6] == (True, 1, "0", "exact", False)
    assert short[3][:2] == (True, 5)
    assert short[4] == short[5] == short[9] == short[10] == (False, None, None, None, False)
    assert short[7] == (True, 3, "0", "phonetic_voice", True)
    assert short[8] == (True, 19, "19", "phonetic_voice", True)
