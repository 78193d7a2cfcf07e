import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodefuse.functions import text as tx
from lodefuse.sources import listings, transit, vectors
from lodefuse.streaming import interactions


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_slug_and_category(spark):
    assert values(spark, [" Zürich", "Genève", "St. Gallen", "Biel/Bienne", "", None, "Neuchâtel", "Uster"], tx.slug) == ["zurich", "geneva", "st-gallen", "biel", None, None, "neuchatel", "uster"]
    assert values(spark, ["Wohnung", "Nie gehört", "", None], tx.category) == ["apartment", "other", None, None]


def test_streets_and_urls(spark):
    assert values(spark, ["Bahnhofstrasse 12a", "Am Weg", None], tx.street) == ["bahnhofstrasse", "am weg", None]
    assert values(spark, ["Bahnhofstrasse 12a", "Am Weg"], tx.house_number) == ["12a", None]
    assert values(spark, ["https://x.ch/show/123?a=1", "https://x.ch/show/123", "https://x.ch/show/123/x"], tx.url_id) == ["123", "123", None]


def test_html_and_language(spark):
    assert values(spark, ["<p>a<br/>b</p>", "  ", None], tx.html_text) == ["a b", None, None]
    assert values(spark, ["Die Wohnung ist hell und neu", "une chambre avec cuisine", "the flat with a kitchen", "xyz", None], tx.language) == ["de", "fr", "en", "unk", "unk"]


def test_numbers_in_texts(spark):
    assert values(spark, ["ca. 85 m2", "5 m2", "1200m²", "123456 m2"], tx.area) == [85, None, None, None]
    assert values(spark, ["im 3. Stock", "Erdgeschoss, 2. OG", "Untergeschoss", "2ème étage", "x"], tx.floor) == [3, 0, -1, 2, None]
    assert values(spark, ["Baujahr: 1987", "Baujahr 1700", "built in 2040"], lambda c: tx.year_built(c, 2026)) == [1987, None, None]
    assert values(spark, ["PT1H29M30S", "PT45M", "nope"], tx.iso_minutes) == [90, 45, None]
    assert values(spark, ["3.0", "UNKNOWN", "7"], tx.safe_int) == [3, None, 7]
    got = values(spark, ["ab sofort", "ab 2026-03-01", "per 01.04.2026", "2031-01-01"], lambda c: tx.available(c, "2026-02-01"))
    assert got == [dt.date(2026, 2, 1), dt.date(2026, 3, 1), dt.date(2026, 4, 1), None]


def test_contacts(spark):
    assert values(spark, ["Tel. 044 123 45 67", "+41 (0)79 123 45 67", "none"], tx.phone) == ["+41 44 123 45 67", "+41 79 123 45 67", None]
    assert values(spark, ["Mail: Info@Best-Homes.ch."], tx.email) == ["info@best-homes.ch"]
    assert values(spark, ["info@best-homes.ch", "me@gmail.com"], tx.agency) == ["Best Homes", None]


@pytest.mark.parametrize(
    ("text", "lang", "negated"),
    [("Wohnung ohne Balkon", "de", True), ("Kein Larm, dafür ein Balkon", "de", False), ("logement pas de balcon", "fr", True), ("spacious balcony overlooking", "en", False), ("appartamento senza balcone", "it", True)],
)
def test_negation_looks_three_words_back(spark, text, lang, negated):
    patterns = {"de": [r"\bBalkon(?:e|en|s)?\b"], "fr": [r"\bbalcons?\b"], "it": [r"\bbalcon[ei]\b"], "en": [r"\bbalcon(?:y|ies)\b"]}
    hit = values(spark, [text], lambda c: tx.mention(c, patterns, F.lit(lang)))[0]
    assert hit.lang == lang and hit.negated is negated


def test_says(spark):
    df = spark.createDataFrame([("Bad  wird\ngeteilt", "bad wird GETEILT"), ("abc", ""), (None, "x")], "t string, s string")
    assert [r.v for r in df.select(tx.says(F.col("t"), F.col("s")).alias("v")).collect()] == [True, False, False]


def test_listing_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('listing_id,title,description,city,price,rent_net,rent_extra,rooms,features_json,feature_elevator,images_json,available_from\n1.0, A ,"<b>x</b>\ny",Zürich,"2\'500",,,3.5,"[""balcony""]",no,"{""images"": [""u1"", ""u2""]}",01.03.2026\n2,NULL,,Bern,,1800,200,x,,,,\n')
    raw = listings.read_csv(spark, str(tmp_path / "a.csv"))
    got = {r.listing_id: r for r in listings.normalized(raw).collect()}
    assert got["1"].title == "A" and got["1"].description == "x y" and got["1"].price == 2500 and got["1"].feature_balcony == 1 and got["1"].feature_elevator == 0
    assert got["1"].image_urls == ["u1", "u2"] and got["1"].available_from == "2026-03-01" and got["1"].city_slug == "zurich"
    assert got["2"].title is None and got["2"].price == 2000 and got["2"].rooms is None and got["2"].feature_parking is None
    assert listings.drift(raw, ["listing_id", "zip"])["missing"] == ["zip"]


def test_urls_reorder_and_upsert(spark):
    df = spark.createDataFrame([(["a/1.jpg", "a/2.jpg", "a/3.jpg"], "2"), (["a/1.jpg"], "9")], "u array<string>, s string")
    assert [r.v for r in df.select(listings.with_first(F.col("u"), F.col("s")).alias("v")).collect()] == [["a/2.jpg", "a/1.jpg", "a/3.jpg"], ["a/1.jpg"]]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(listings.upserted(a, b, "k")) == [(1, "x"), (2, "z"), (3, "w")]
    assert rows(listings.upserted(a, b, "k", replace=False)) == [(1, "x"), (2, "y"), (3, "w")]


def test_export_and_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], 5), (2, ["b"], 9), (3, [], 5)], "listing_id int, tags array<string>, n int")
    listings.export(df, str(tmp_path / "out"), F.col("n"), 2)
    assert sorted(r.listing_id for r in spark.read.json(f"{tmp_path}/out/json").collect()) == [1, 2]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in listings.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]


def test_timetable(spark, tmp_path):
    from lodefuse.operators.signals import stop_profiles

    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon,parent_station\n s1 ,A,47,8,P\ns2,B,47,8,P\ns1,again,1,1,\nP,Main,47,8,\n")
    (tmp_path / "routes.txt").write_text("route_id,route_type\nr1,3\nr2,0\n")
    (tmp_path / "trips.txt").write_text("trip_id,route_id\nt1,r1\nt2,r1\nt3,r2\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id\nt1,s1\nt2,s2\nt3,s2\nt9,s1\n")
    own = {n: transit.read(spark, str(tmp_path), n) for n in ("stops", "routes", "trips", "stop_times")}
    assert {r.stop_id: r.stop_name for r in own["stops"].collect()} == {"s1": "A", "s2": "B", "P": "Main"}
    assert [tuple(r) for r in stop_profiles(own["stop_times"], own["trips"], own["routes"], own["stops"]).collect()] == [("P", 2, 3)]


def test_vector_store_refuses_bad_rows(spark, tmp_path):
    good = spark.createDataFrame([("a", "main", [1.0, 0.0]), ("b", "floorplan", [0.0, 1.0])], "image_id string, index_kind string, embedding array<double>")
    vectors.write(good, str(tmp_path / "v"), 2)
    assert [r.image_id for r in vectors.read(spark, str(tmp_path / "v")).collect()] == ["a"]
    for bad in (("c", "main", [2.0, 0.0]), ("c", "main", [1.0]), ("c", "dropped", [1.0, 0.0])):
        with pytest.raises(Exception, match="not to be stored"):
            vectors.write(spark.createDataFrame([bad], good.schema), str(tmp_path / "w"), 2)


def test_streams_equal_batches(spark, tmp_path):
    from lodefuse.operators import memory

    t = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    schema = "id long, user_id long, listing_id string, kind string, value double, created_at timestamp"
    spark.createDataFrame([(2, 1, "a", "undismiss", 0.0, t(5)), (1, 1, "a", "dismiss", 0.0, t(1)), (3, 2, "b", "like", 0.0, t(2))], schema).write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    for name, f in (("latest_q", interactions.latest), ("weights_q", interactions.running_weights)):
        run = f(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName(name).start()
        run.processAllAvailable()
        run.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(batch).collect()))
    assert {(r.user_id, r.kind) for r in interactions.latest(batch).collect()} == {(1, "undismiss"), (2, "like")}
    assert {(r.user_id, r.listing_id): r.weight for r in memory.weights(batch).collect()}[1, "a"] == 0.0
    limited = interactions.rate_limited(spark.createDataFrame([(i, 1, "", "", 0.0, t(i)) for i in range(8)], schema), 3, 300)
    assert [r.tries for r in limited.orderBy("id").collect()] == [1, 2, 3, 4, 5, 5, 5, 5]


def test_html_parser_form(spark):
    assert values(spark, ["a &amp; b", "<p>a &amp; b</p><script>x</script>", None, ""], tx.html_parsed) == ["a &amp; b", "a & bx", None, ""]


def test_triage_leans_to_what_is_kept(spark):
    from lodefuse.functions.vectors import triage

    labels, keep = ["inside", "outside", "logo"], {"inside", "outside"}
    df = spark.createDataFrame([([0.30, 0.1, 0.1],), ([0.1, 0.2, 0.201],), ([0.1, 0.1, 0.3],)], "s array<double>")
    assert [r.v for r in df.select(triage(labels, F.col("s"), keep).alias("v")).collect()] == ["inside", "outside", "logo"]
