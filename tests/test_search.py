import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodefuse.operators import bm25, explain, ranking
from lodefuse.operators.gate import FilterSpec, gate, map_points, page

LISTINGS = [
    ("a1", "zurich", 8051, "ZH", 1850, 2.5, 61, 2, 1987, "2025-02-10", 47.41, 8.56, "apartment", 1, 0, 0),
    ("a2", "zurich", 8032, "ZH", 3150, 4.0, 97, 5, 2018, "2025-09-01", 47.366, 8.565, "apartment", 1, 1, 0),
    ("b1", "lugano", 6900, "TI", 1420, 2.0, 48, -1, 1964, "2025-01-05", 46.005, 8.952, "apartment", 0, 0, 1),
    ("b2", "lugano", 6962, "TI", 2650, 5.5, 140, 0, 2022, "2025-12-15", 46.02, 8.97, "house", 1, 0, 1),
    ("c1", "lausanne", 1004, "VD", 2100, 3.0, 72, 4, 2009, "2025-05-20", 46.53, 6.62, "studio", 0, 1, 0),
    ("d1", "sion", 1950, "VS", None, None, None, None, None, None, None, None, None, None, 0, 0),
]
SCHEMA = "listing_id string, city_slug string, postal_code int, canton string, price int, rooms double, area int, floor int, year_built int, available_from string, latitude double, longitude double, object_category string, feature_balcony int, feature_elevator int, feature_parking int"


@pytest.fixture(scope="module")
def listings(spark):
    return spark.createDataFrame(LISTINGS, SCHEMA)


def ids(df):
    return sorted(r.listing_id for r in df.collect())


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (FilterSpec(city=[" Z\u00fcrich ", ""]), ["a1", "a2"]),
        (FilterSpec(city=["Zurich", "LUGANO"]), ["a1", "a2", "b1", "b2"]),
        (FilterSpec(city=["Nowhere"]), []),
        (FilterSpec(city=[" ", ""]), ["a1", "a2", "b1", "b2", "c1", "d1"]),
        (FilterSpec(min_price=1850, max_price=2100), ["a1", "c1"]),
        (FilterSpec(max_floor=-1), ["b1"]),
        (FilterSpec(features=["balcony"], features_excluded=["elevator"]), ["a1", "b2"]),
        (FilterSpec(features_excluded=["balcony"]), ["b1", "c1"]),
        (FilterSpec(object_category=["apartment"]), ["a1", "a2", "b1", "d1"]),
        (FilterSpec(object_category=["apartment", "house"]), ["a1", "a2", "b1", "b2"]),
        (FilterSpec(available_from="2025-05-20"), ["a2", "b2", "c1"]),
        (FilterSpec(latitude=47.41, longitude=8.56, radius_km=6), ["a1", "a2"]),
        (FilterSpec(latitude=47.41, longitude=8.56, radius_km=0), ["a1"]),
        (FilterSpec(city=[], features=["unheard_of"]), ["a1", "a2", "b1", "b2", "c1", "d1"]),
    ],
)
def test_gate(listings, spec, want):
    assert ids(gate(listings, spec)) == want


def test_nulls_sort_last_both_ways_and_paging(listings):
    for by in ("price_asc", "price_desc"):
        spec = FilterSpec(sort_by=by)
        assert [r.listing_id for r in page(gate(listings, spec), spec).collect()][-1] == "d1"
    spec = FilterSpec(sort_by="price_asc", limit=2, offset=1)
    assert [r.listing_id for r in page(gate(listings, spec), spec).collect()] == ["a1", "c1"]


def test_an_override_sets_only_what_it_names():
    base = FilterSpec(canton="ZH", limit=7, offset=40, near_landmarks=["hb"], soft={"price": "cheap", "quiet": True})
    got = base.merged(FilterSpec(max_price=5, near_landmarks=["eth"], soft={"price": "premium", "parks": None}))
    assert (got.limit, got.offset, got.canton, got.max_price) == (7, 40, "ZH", 5)
    assert got.near_landmarks == ["eth"] and got.soft == {"price": "premium", "quiet": True}
    assert base.merged(FilterSpec()) == base


def test_map_leaves_out_what_has_no_place(listings):
    assert ids(map_points(listings, FilterSpec(limit=1))) == ["a1", "a2", "b1", "b2", "c1"]


def test_landmarks_are_any_of(spark, listings):
    near = spark.createDataFrame([("a1", "lake", 2999.0), ("a2", "lake", 3000.0), ("b1", "fair", 10.0), ("b2", "fair", None)], "listing_id string, landmark_key string, dist_m double")
    assert ids(gate(listings, FilterSpec(near_landmarks=["lake", "fair"]), near)) == ["a1", "b1"]
    assert ids(gate(listings, FilterSpec(near_landmarks=["lake' OR 1=1", "fair"]), near)) == ["b1"]


def test_index_equals_scan_and_sees_phrases(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 11)), f"w{i % 3} w{i % 5}" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "listing_id long, title string, description string").repartition(3)
    bm25.build(df, "listing_id", ["title", "description"], f"file://{tmp_path}/index")
    index = bm25.Index(spark, f"file://{tmp_path}/index")
    for keywords in (["w1"], ["w0 w0"], ["w2 w4 w6", "w5"], ["w3 w3 w3"], ["absent"], ["w1 w2", "w1"], [" ", '"']):
        want = {r.listing_id: r.score for r in bm25.score(df, "listing_id", ["title", "description"], keywords).collect()}
        got = {r.listing_id: r.score for r in index.score(keywords).collect()}
        assert set(got) == set(want), keywords
        assert all(math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in want.items())


DOCS = [
    ("n1", "Loft am See", "Grosses Loft mit Galerie, hohen Räumen und einer Terrasse über dem Wasser."),
    ("n2", "Garden flat", "Quiet garden flat, a terrace of its own, five minutes from the station."),
    ("n3", "Près du marché", "Trois pièces rénovées près du marché, cuisine ouverte, cave."),
    ("n4", "Terrace house", "Terrace house with a garden; the terrace looks south."),
    ("n5", "Zimmer", "Zimmer in ruhiger WG, alles zu Fuss."),
]


@pytest.mark.parametrize("keywords", [["terrace"], ["marche", "loft"], ["garden flat", "quiet"], ['"pres"', " "], ["of its own"], ["nothing here"]])
def test_bm25_equals_sqlite(spark, keywords):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, description, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", DOCS)
    match = " OR ".join(f'"{k.replace(chr(34), "").strip()}"' for k in keywords if k.replace('"', "").strip())
    want = dict(con.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall())
    df = spark.createDataFrame(DOCS, "listing_id string, title string, description string")
    got = {r.listing_id: r.score for r in bm25.score(df, "listing_id", ["title", "description"], keywords).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12), (k, got[k], v)


def test_bm25_without_keywords(spark):
    df = spark.createDataFrame(DOCS, "listing_id string, title string, description string")
    assert bm25.score(df, "listing_id", ["title"], ["", '"']).count() == 0


def test_rrf_counts_the_first_place_only(spark):
    rows = [("a", "A", 1), ("a", "B", 2), ("b", "A", 1), ("b", "C", 2), ("c", "B", 1), ("c", "A", 2), ("c", "A", 3)]
    got = {r.listing_id: r.rrf for r in ranking.rrf([spark.createDataFrame(rows, "ranking string, listing_id string, rank int")]).collect()}
    assert got == pytest.approx({"A": 2 / 61 + 1 / 62, "B": 1 / 61 + 1 / 62, "C": 1 / 62})


SOFT = [
    ("s1", 1, 0.3, None, "normal", 400.0, 8, 900.0, None, 4, 31.0),
    ("s2", 2, -0.15, 0.2, None, 90.0, None, 150.0, 60.0, 0, None),
    ("s3", 3, -0.4, -0.4, "suspect", None, 35, None, 700.0, 2, 12.0),
    ("s4", 4, None, 0.05, "normal", 250.0, 120, 40.0, 10.0, 4, 12.0),
    ("s5", 5, None, None, None, None, None, None, None, None, None),
]


def test_soft_rankings(spark):
    pool = spark.createDataFrame(SOFT, "listing_id string, pool_pos int, price_delta_canton double, price_delta_plz double, plausibility string, stop_m double, lines int, motorway_m double, primary_m double, schools int, commute_proxy_min double")
    travel = spark.createDataFrame([("s2", "fair", 9, None), ("s1", "fair", None, 4000.0), ("s1", "lake", None, None)], "listing_id string, landmark_key string, travel_min int, dist_m double")
    found = ranking.soft_rankings(pool, price="cheap", quiet=True, transit=True, commute="fair", counts=("schools",), landmarks=("fair",), travel=travel)
    got = {}
    for df in found:
        for r in df.orderBy("rank").collect():
            got.setdefault(r.ranking, []).append(r.listing_id)
    assert got["price"] == ["s2", "s4", "s1"]
    assert got["quiet"] == ["s1", "s3", "s2", "s4"]
    assert got["transit"] == ["s4", "s3", "s1", "s2"]
    assert got["commute"] == ["s2", "s3", "s4", "s1"]
    assert got["schools"] == ["s1", "s4", "s3", "s2"]
    assert got["landmark_fair"] == ["s2", "s1"]
    assert all("s5" not in x for x in got.values())
    assert ranking.soft_rankings(pool, price="moderate") == []


def test_reasons_and_words(spark):
    df = spark.range(1).select(
        ranking.blended_score(F.lit(0.0), F.lit(1e9)).alias("none"),
        ranking.blended_score(F.lit(0.0), F.lit(-2.5)).alias("lexical"),
        ranking.blended_score(F.lit(0.03), F.lit(-2.5)).alias("fused"),
        explain.metres(F.lit(450.4)).alias("m"),
        explain.metres(F.lit(2345.0)).alias("km"),
        explain.francs(F.lit(12345)).alias("chf"),
        explain.price_words(F.lit(-0.123)).alias("p"),
    )
    assert tuple(df.first()) == (0.0, 2.5, 0.03, "450 m", "2.3 km", "12'345 CHF", "12% below typical")
