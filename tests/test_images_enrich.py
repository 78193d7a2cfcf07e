from pyspark.sql import functions as F

from lodefuse.operators import enrich, images
from lodefuse.operators.gate import FilterSpec, resolve_landmarks
from lodefuse.plans import search

IMAGES = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 3, [0.6, 0.8]), ("b", 4, [0.6, 0.8])]


def test_best_images_and_batches(spark):
    own = spark.createDataFrame(IMAGES, "listing_id string, image_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert {r.listing_id: r.image_id for r in images.best_image(own, q.where("query_id = 1")).collect()} == {"a": 2, "b": 3}
    got = {(r.query_id, r.place): (r.listing_id, r.image_id) for r in images.batch_search(own, q, 1).collect()}
    assert got == {(1, 1): ("a", 2), (2, 1): ("a", 1)}
    assert {r.image_id: r.ok for r in images.self_match(own, own).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert [r.image_id for r in images.orphans(own, own.where("image_id > 1")).collect()] == [1]


def test_image_ids(spark):
    source, platform, stem = images.image_id(F.col("i"))
    row = spark.createDataFrame([("feed/77/pic_1.jpg",)], "i string").select(source.alias("a"), platform.alias("b"), stem.alias("c")).first()
    assert tuple(row) == ("feed", "77", "pic_1")


def test_landmark_names(spark):
    gazetteer = spark.createDataFrame([("eth_zentrum", ["ETH", "ETH Zürich"]), ("hb_zurich", ["Zürich HB"])], "key string, aliases array<string>")
    names = spark.createDataFrame([("eth_zentrum",), ("eth",), ("HB Zürich",), ("zurich eth",), ("nowhere",)], "name string")
    got = {r.name: r.key for r in resolve_landmarks(names, gazetteer).collect()}
    assert got == {"eth_zentrum": "eth_zentrum", "eth": "eth_zentrum", "HB Zürich": "hb_zurich", "zurich eth": "eth_zentrum"}


def test_passes(spark):
    rows = spark.createDataFrame([("1", 47.00001, 8.0), ("2", 40.0, 8.0)], "listing_id string, lat double, lng double")
    cache = spark.createDataFrame([(47.00002, 8.0, "ZH"), (47.00001, 8.0, "AG")], "lat double, lng double, value string")
    assert [(r.listing_id, r.value) for r in enrich.cached(rows, cache, "canton").collect()] == [("1", "AG")]
    text, answer = F.lit("Das Bad wird  geteilt"), F.lit("bad wird geteilt")
    value, sure = enrich.checked(F.lit("true"), answer, text, F.lit(0.9), 0.7)
    assert tuple(spark.range(1).select(value, sure).first()) == ("true", 0.7)
    existing = spark.createDataFrame([("a", "A, Switzerland")], "key string, display_name string")
    mined = spark.createDataFrame([("a", "x, Switzerland"), ("b", "B, Switzerland"), ("c", "C, France"), ("d", "D, Switzerland")], existing.schema)
    dropped = spark.createDataFrame([("d", "too vague")], "key string, reason string")
    assert sorted(r.key for r in enrich.curated(existing, mined, dropped, "Switzerland$").collect()) == ["a", "b"]


def test_search_metadata(spark):
    assert search.activated({"price": "moderate", "quiet": True, "near_landmark": ["ETH"]}) == ["quiet", "near_landmark:ETH"]
    assert search.snapshot({"bm25": 3, "dense": 0}, 3)["channels"] == ["bm25"]
    page = spark.createDataFrame([("1", "bern", 100)], "listing_id string, city_slug string, price int")
    got = search.explained(page, FilterSpec(city=["bern"], max_price=50)).first()
    assert [(c.label, c.passed) for c in got.checks] == [("city", True), ("price", False)]


def test_self_match_against_all_pairs_without_meeting_them(spark):
    import random

    from lodefuse.operators import images

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    rows += [(100 + i, list(v)) for i, v in rows[:10]] + [(200 + i, [x * 1.5 for x in v]) for i, v in rows[20:25]] + [(7000, None)]
    unit = [(i, v and [x / sum(y * y for y in v) ** 0.5 for x in v]) for i, v in rows]
    for own in (rows, unit):
        df = spark.createDataFrame(own, "image_id long, embedding array<double>")
        got = {r.image_id: r.ok for r in images.self_match(df, df).collect()}
        dot = lambda a, b: sum((x * y for x, y in zip(a, b)), 0.0)  # noqa: E731, B905
        have = [(i, v) for i, v in own if v]
        want = {i: min((-dot(e, v), k) for k, e in have)[1] == i for i, v in have} | {7000: False}
        assert got == want
        plan = images.self_match(df, df)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
