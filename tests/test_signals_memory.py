import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lodefuse.operators import audit, diversify, enrich, entities, memory, signals


def test_price_baselines(spark):
    rows = [(2000 + i, "ZH", 3.0) for i in range(5)] + [(p, "BE", 2.0) for p in (2000, 2050, 2100, 2150, 2200, 500000)] + [(1, "GE", 3.0)] * 4 + [(0, "ZH", 3.0), (-1, "ZH", 3.0), (None, "ZH", 3.0), (9, None, 3.0)]
    df = spark.createDataFrame(rows, "price int, canton string, rooms double")
    got = {r.canton: (r.baseline, r.n) for r in signals.price_baselines(df, ["canton", "rooms"]).collect()}
    assert got == {"ZH": (2002.0, 5), "BE": (2125.0, 6)}
    delta = signals.price_delta(df, signals.price_baselines(df, ["canton", "rooms"]), ["canton", "rooms"], "d")
    assert {r.price: r.d for r in delta.where("canton = 'BE'").collect()}[500000] == round((500000 - 2125) / 2125, 4)


def test_rooms_and_hardening(spark):
    rooms = spark.createDataFrame([(3.25,), (2.75,), (0.1,), (15.2,), (None,)], "r double").select(signals.rooms_bucket(F.col("r")).alias("b"))
    assert [r.b for r in rooms.collect()] == [3.5, 3.0, None, 15.0, None]
    row = spark.range(1).select(signals.plausibility(F.lit(3.2)).alias("a"), signals.plausibility(F.lit(-0.07)).alias("b"), signals.plausibility(F.lit(None).cast("double")).alias("c"), signals.clamp(F.lit(41083), 0, 100).alias("d"), signals.commute_proxy(F.lit(160.0), F.lit(None).cast("double")).alias("e")).first()
    assert tuple(row) == ("suspect", "normal", None, 100.0, None)


def haversine(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_spatial_joins_equal_brute_force(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(45.8, 47.9), rng.uniform(5.9, 10.5)) for i in range(150)] + [(999, None, None)]
    targets = [(i, rng.uniform(46.5, 47.0), rng.uniform(7, 8)) for i in range(20)]
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    t = spark.createDataFrame(targets, "target_id long, tlat double, tlon double")
    near = {r.id: (r.target_id, r.dist_km) for r in signals.nearest(p, t, 3.0).collect()}
    assert near == {r.id: (r.target_id, r.dist_km) for r in signals.nearest(p, t).collect()}
    assert signals.nearest(p, t.limit(0)).count() == 0
    counts = {r.id: r.n for r in signals.radius_count(p, t, 35.0).collect()}
    for i, lat, lon in points[:-1]:
        all_ = sorted((haversine(lat, lon, a, b), k) for k, a, b in targets)
        assert near[i][0] == all_[0][1] and math.isclose(near[i][1], all_[0][0], rel_tol=1e-9)
        assert counts[i] == sum(x <= 35 for x, _ in all_)
    assert 999 not in near and counts[999] == 0


def at(minutes):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minutes)


EVENT = "id long, user_id long, listing_id string, kind string, value double, created_at timestamp"


def test_weights_and_cold_start(spark):
    rows = [(1, 1, "a", "save", None, at(0)), (2, 1, "a", "unsave", None, at(1)), (3, 1, "b", "dismiss", None, at(0)), (4, 1, "b", "undismiss", None, at(1)), (5, 1, "c", "dwell", 5.0, at(0)), (6, 1, "d", "dwell", 4.9, at(0)), (7, 1, "e", "dismiss", None, at(3)), (8, 1, "f", "bookmark", None, at(3)), (9, 2, "x", "like", None, at(3)), (10, 2, "y", "like", None, at(3)), (11, 2, "z", "click", None, at(3)), (12, 2, "z", "like", None, at(-60 * 24 * 400))]
    events = memory.recent(spark.createDataFrame(rows, EVENT), "2026-01-02")
    got = {(r.user_id, r.listing_id): (r.weight, r.dismissed) for r in memory.weights(events).collect()}
    assert got[1, "a"] == (0.0, False) and got[1, "b"] == (0.0, False) and got[1, "c"] == (2.0, False) and got[1, "d"] == (0.0, False)
    assert got[1, "e"] == (-2.0, True) and got[1, "f"] == (5.0, False) and got[2, "z"] == (1.0, False)
    assert {r.user_id: r.cold for r in memory.cold_start(memory.weights(events)).collect()} == {1: True, 2: False}
    last = {(r.user_id, r.listing_id): r.kind for r in memory.latest(events, ["dismiss", "undismiss"]).collect()}
    assert last == {(1, "b"): "undismiss", (1, "e"): "dismiss"}


def test_taste_and_price(spark):
    found = spark.createDataFrame([(1, "a", 3.0), (1, "b", -2.0), (1, "c", 1.0)], "user_id long, listing_id string, weight double")
    listings = spark.createDataFrame([("a", 1000, 1, None), ("b", 2000, 1, 0), ("c", 4000, 0, 0)], "listing_id string, price int, f int, g int")
    taste = {r.feature: r.taste for r in memory.feature_taste(found, listings, ["f", "g"]).collect()}
    assert taste == pytest.approx({"f": (3 - 2 - 1) / 6, "g": (2 - 1) / 3})
    stats = memory.price_stats(found, listings).first()
    logs = [math.log(1000), math.log(4000)]
    assert stats.mu == pytest.approx(sum(logs) / 2) and stats.sigma == pytest.approx(abs(logs[0] - logs[1]) / math.sqrt(2))
    assert memory.price_stats(found.where("listing_id = 'a'"), listings).first().sigma == 0.3


def test_demotion_keeps_order(spark):
    pool = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "listing_id string, pool_pos int")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.1, 0.99])], "listing_id string, embedding array<double>")
    gone = spark.createDataFrame([("b",)], "listing_id string")
    order = lambda cold: [r.listing_id for r in memory.demoted(pool, vectors, gone, cold).orderBy("place").collect()]
    assert order(True) == ["a", "c", "b"] and order(False) == ["a", "b", "c"]


def test_pareto_equals_plain_dominance(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(12)]), rng.randint(0, 12), rng.choice([None, 1, 2])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, price int, commute int, area int")
    inf = float("inf")
    for low, high in ((["price", "commute"], []), (["price", "commute"], ["area"]), (["price"], ["area"])):
        value = {r[0]: tuple([inf if dict(zip(("price", "commute", "area"), r[1:], strict=True))[c] is None else s * dict(zip(("price", "commute", "area"), r[1:], strict=True))[c] for c, s in [(c, 1) for c in low] + [(c, -1) for c in high]]) for r in rows}
        want = [i for i, v in value.items() if not any(all(a <= b for a, b in zip(o, v, strict=True)) and o != v for o in value.values())]
        assert sorted(r.id for r in diversify.pareto(df, "id", low, high).collect()) == sorted(want)


def test_mmr(spark):
    df = spark.createDataFrame([("a", 0.9, "Zurich", 2100.0), ("b", 0.85, "Zurich", 2180.0), ("c", 0.8, "Bern", 2900.0)], "id string, relevance double, city string, price double")
    got = diversify.mmr(df, "id", "relevance", {"city": None, "price": 500.0}, 2, 0.4).orderBy("place")
    assert [r.id for r in got.collect()] == ["a", "c"]
    assert diversify.mmr(df, "id", "relevance", {"city": None}, 9, 1.0).count() == 3
    with pytest.raises(ValueError):
        diversify.mmr(df, "id", "relevance", {}, 2, 1.5)


def test_entities(spark):
    names = spark.createDataFrame([("k", n) for n in ("bahnhof", "bahnhof_bern", "bahnhof_bern_sbb", "hb", "hbz_zurich", "see")] + [("j", "bahnhof")], "kind string, canonical string")
    got = {(r.kind, r.canonical): r.root for r in entities.merged(names).collect()}
    assert got["k", "bahnhof_bern_sbb"] == got["k", "bahnhof_bern"] == "bahnhof"
    assert got["k", "hbz_zurich"] == "hbz_zurich" and got["k", "hb"] == "hb" and got["j", "bahnhof"] == "bahnhof"
    mentions = spark.createDataFrame([("l1", "x", "k"), ("l1", "x", "k"), ("l2", "x", "k"), ("l1", " ", "k"), ("l1", "x", "j")], "listing_id string, canonical string, kind string")
    assert {(r.canonical, r.kind): r.listings for r in entities.grouped(mentions).collect()} == {("x", "k"): 2, ("x", "j"): 1}


def test_enrichment_never_overwrites(spark):
    df = spark.createDataFrame([("1", "Bern", None), ("2", None, "5")], "listing_id string, city string, floor string")
    state = enrich.seed(df, ["city", "floor"])
    proposals = spark.createDataFrame([("1", "city", "Basel", "geo", 0.9, "x"), ("1", "floor", "2", "text", 0.8, "2. OG")], "listing_id string, field string, value string, by string, sure double, said string")
    done = enrich.sentinel_fill(enrich.overlay(state, proposals))
    got = {(r.listing_id, r.field): (r.filled, r.source, r.confidence) for r in done.collect()}
    assert got == {("1", "city"): ("Bern", "original", 1.0), ("1", "floor"): ("2", "text", 0.8), ("2", "city"): ("UNKNOWN", "UNKNOWN", 0.0), ("2", "floor"): ("5", "original", 1.0)}
    assert tuple(enrich.violations(done).first()) == (0, 0, 0, 0)
    dropped = enrich.drop_bad(state, F.expr("field = 'floor' AND filled = '5'"), F.lit("odd"))
    assert dropped.where("source = 'DROPPED_bad_data'").first().raw == "odd:original_was=5"


def test_audit(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.95,), (1.0,), (1.5,), (None,)], "c double")
    assert {r.bin: r.n for r in audit.histogram(df, "c").collect()} == {0: 2, 9: 2, **{i: 0 for i in range(1, 9)}}
    curve = {r.t: r.reachable for r in audit.isochrone(spark.createDataFrame([(0.5,), (3.2,), (95.0,)], "m double"), "m").collect()}
    assert curve[1] == 1 and curve[3] == 1 and curve[4] == 2 and curve[90] == 2
    assert {r.field: (r.filled, r.total) for r in audit.coverage(df, ["c"]).collect()} == {"c": (5, 6)}
    assert audit.profile(spark.createDataFrame([("1",), ("22",), (None,)], "s string"), "s").first()["class"] == "int"


def test_radius_count_meets_places_once(spark):
    from lodefuse.operators import signals as sg

    points = spark.createDataFrame([(1, 46.0, 7.0), (2, 46.0, 7.0), (3, None, 7.0), (4, 50.0, 7.0), (5, 46.1, 7.0), (5, 46.0, 7.0)], "id long, lat double, lon double")
    targets = spark.createDataFrame([(i, 46.05, 7.0) for i in range(3)] + [(9, 46.0, 7.0)], "target_id long, tlat double, tlon double")
    got = sorted(tuple(r) for r in sg.radius_count(points, targets, 10.0).collect())
    assert got == [(1, 4), (2, 4), (3, 0), (4, 0), (5, 7)]  # 46.1 is 11.1 km from 46.0
