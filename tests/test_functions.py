import pytest
from pyspark.sql import functions as F

from addrforge.functions import geo, house_numbers, phonetic, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize("given, wanted", [("Hauptstraße", "hauptstrasse"), ("  Am  Neuen-Kamp! ", "am neuen kamp"), ("", ""), (None, None)])
def test_normalize_string(spark, given, wanted):
    assert one(spark, given, text.normalize_string) == wanted


def test_consonant_key_and_city_key(spark):
    assert one(spark, "Bahnhofstraße", text.consonant_key) == "bnfstrs"
    assert one(spark, "Kreis Plön", text.city_key) == "ploen"


def test_title_case_keeps_hyphen_parts(spark):
    assert one(spark, "albert-schweitzer-straße", text.title_case) == "Albert-Schweitzer-Straße"
    assert one(spark, "kieler straße", text.title_case) == "Kieler Straße"


def test_cologne_keeps_zeros_and_double_codes(spark):
    assert one(spark, "Müller", phonetic.cologne_code) == "60507"
    assert one(spark, "Xaver", phonetic.cologne_code) == "480307"


def nearest(spark, target, listed):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(listed)], "i long, c string")
    key = house_numbers.closeness(F.lit(target), F.col("c"), F.col("i"))
    return rows.agg(F.min_by("c", key).alias("c")).first()["c"]


@pytest.mark.parametrize(
    "target, listed, wanted",
    [("7", ["3", "7", "7a", "9"], "7"), ("64b", ["60", "64a", "64d", "68"], "64a"), ("12-14", ["11", "14", "40"], "11"), (" 5 ", ["1", "5"], "5"), ("100", ["99", "101"], "101"), ("8", [], None)],
)
def test_nearest_house_number(spark, target, listed, wanted):
    assert nearest(spark, target, listed) == wanted


def test_haversine(spark):
    row = spark.range(1).select(geo.haversine(F.lit(54.0), F.lit(10.0), F.lit(54.0), F.lit(10.0)).alias("same"), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("degree")).first()
    assert row["same"] == 0 and abs(row["degree"] - 111.19) < 0.01
