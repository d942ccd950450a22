"""What repeats in a batch is answered once: joins make no row for each pair of a request and a street of its name."""

import pytest
from addrforge.operators import retrieve, reverse, streets, validate
from addrforge.plans.queries import QUERIES

COPIES, SAME = 300, 200


def most_joined(df):
    """Rows of the result and the most rows that a join of its plan made."""
    n = len(df.collect())

    def walk(p):
        kind = p.getClass().getSimpleName()
        kids = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        held = p.metrics().get("numOutputRows") if "Join" in kind else None
        return max([held.get().value() if held is not None and held.isDefined() else 0, *map(walk, kids)])

    return n, walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k, ("Kieler Straße", "Bahnhofweg")[k % 2], "Kiel", "24103", 54.3 + (k // 2 % 2) * 1e-3, 10.1) for k in range(2 * SAME)]
    known = streets.derive(spark.createDataFrame(rows, "street_id long, name string, city string, postal_code string, latitude double, longitude double"))
    asked = spark.createDataFrame([(k, "kieler straße", 54.3, 10.1) for k in range(COPIES)], "query_id long, query string, lat double, lon double")
    return asked, known


@pytest.mark.parametrize("stage", ["prefix_search", "trigram_bm25", "fuzzy_trigram", "phonetic_search", "typo_search", "broad_search"])
def test_names_are_scored_instead_of_streets(tables, stage):
    df = getattr(retrieve, stage)(*tables, limit=3)
    n, joined = most_joined(df)
    assert n == 3 * COPIES and joined <= 4 * COPIES
    first = [0, 4, 8] if stage == "broad_search" else [0, 2, 4]
    assert sorted((r["query_id"], r["street_id"]) for r in df.collect()) == [(q, s) for q in range(COPIES) for s in first]


def test_pairs_meet_in_blocks(tables):
    n, joined = most_joined(retrieve.levenshtein_join(*tables))
    assert n == COPIES * SAME and joined <= 2 * (COPIES + 2 * SAME)


@pytest.mark.parametrize("name", ["autocomplete", "geojson", "nominatim_rows"])
def test_the_plan_does_not_hold_the_waves(spark, name):
    assert len(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()) < 300_000


@pytest.mark.parametrize("voice", [False, True])
def test_equal_requests_are_answered_once(spark, tables, voice):
    asked = spark.createDataFrame([(k, "Kieler Straße", "5" if k % 2 else "7c", "Kiel", 54.3, 10.1) for k in range(COPIES)] + [(COPIES, "Kieler Straße", "5", "Bonn", None, None)], "query_id long, street_name string, house_number string, city string, lat double, lon double")
    numbers = spark.createDataFrame([(1000 * n + k, k, str(n), 54.3 + k * 1e-5, 10.1) for k in range(0, 2 * SAME, 2) for n in (5, 8)], "address_id long, street_id long, house_number string, latitude double, longitude double")
    df = validate.validate(asked, tables[1], numbers, voice)
    n, joined = most_joined(df)
    assert n == COPIES + 1 and joined <= 2 * COPIES
    # 8 is the nearest number to 7; of /validate's streets the nearest counts first, whose own number that is
    assert {tuple(r)[1:5] for r in df.collect()} == {(True, 1, 0, 5000), (True, 3, 0, 8000), (False, None, None, None)}


def test_places_are_asked_once_and_near_steps_first(spark, tables):
    rows = [(k, k, 54.3 + 1e-4 + k * 1e-5, 10.1, 54.3 + 1e-4 + k * 1e-5, 10.101) for k in range(2 * SAME)] + [(10_000, 1, 54.33, 10.1, 54.33, 10.101)]
    segments = spark.createDataFrame(rows, "segment_id long, street_id long, start_lat double, start_lon double, end_lat double, end_lon double")
    asked = tables[0].unionByName(spark.createDataFrame([(COPIES, "", 54.36, 10.1), (COPIES + 1, "", None, None), (COPIES + 2, "", 50.0, 10.1)], tables[0].schema))
    df = reverse.nearest_segments(asked, segments)
    n, joined = most_joined(df)
    assert n == COPIES + 1 and joined <= 2 * COPIES
    assert {r["segment_id"] for r in df.collect() if r["query_id"] < COPIES} == {0} and [r["segment_id"] for r in df.collect() if r["query_id"] == COPIES] == [10_000]
