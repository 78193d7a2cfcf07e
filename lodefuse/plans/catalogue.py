"""Registered queries of the engine's own operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodefuse.functions import text as tx
from lodefuse.functions.vectors import dot, norm, softmax
from lodefuse.operators import audit, bm25, diversify, enrich, entities, explain, images, memory, ranking
from lodefuse.operators import signals as sg
from lodefuse.operators.gate import NEAR_M, FilterSpec, bad_price, bad_rooms, gate, inside, map_points, null_island, page, resolve_landmarks, with_enriched
from lodefuse.plans import datasets as ds
from lodefuse.plans import search
from lodefuse.sources.shared import new_path
from lodefuse.streaming import interactions

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- gate

RANGES = FilterSpec(city=["brand#11", "brand#23", "brand#34"], min_price=1000, max_price=1600, min_rooms=2, max_area=140, min_floor=0, available_from="2024-03-01", limit=None)


@query("gate_ranges_in_list", f"{ds.L} SELECT listing_id, price, rooms FROM listings WHERE city_slug IN ('brand#11', 'brand#23', 'brand#34') AND price BETWEEN 1000 AND 1600 AND rooms >= 2 AND area <= 140 AND floor >= 0 AND available_from >= '2024-03-01'")
def _(spark, d):
    return gate(ds.listings(spark, d), RANGES).select("listing_id", "price", "rooms")


@query("gate_null_tolerant_category", f"{ds.L} SELECT listing_id, object_category FROM listings WHERE object_category IN ('apartment', 'loft') OR object_category IS NULL")
def _(spark, d):
    return gate(ds.listings(spark, d), FilterSpec(object_category=["apartment", "loft"])).select("listing_id", "object_category")


@query("gate_strict_category", f"{ds.L} SELECT listing_id, object_category FROM listings WHERE object_category IN ('apartment', 'villa')")
def _(spark, d):
    return gate(ds.listings(spark, d), FilterSpec(object_category=["apartment", "villa"])).select("listing_id", "object_category")


@query("gate_required_excluded_flags", f"{ds.L} SELECT listing_id FROM listings WHERE feature_balcony = 1 AND feature_elevator = 1 AND feature_parking = 0")
def _(spark, d):
    return gate(ds.listings(spark, d), FilterSpec(features=["balcony", "elevator", "sauna"], features_excluded=["parking"])).select("listing_id")


@query("gate_tristate_text_cast", f"{ds.L} SELECT listing_id, bathrooms FROM listings WHERE regexp_matches(bathrooms, '^[0-9]') AND CAST(regexp_extract(bathrooms, '^[0-9]+') AS INT) BETWEEN 2 AND 3 AND has_cellar = 'true'")
def _(spark, d):
    return gate(ds.listings(spark, d), FilterSpec(min_bathrooms=2, max_bathrooms=3, has_cellar=True)).select("listing_id", "bathrooms")


@query("gate_radius_sorted", f"{ds.L} SELECT listing_id, round({ds.km('46.9', '7.4', 'latitude', 'longitude')}, 6) AS distance_km FROM listings WHERE {ds.km('46.9', '7.4', 'latitude', 'longitude')} <= 25 ORDER BY {ds.km('46.9', '7.4', 'latitude', 'longitude')}, listing_id LIMIT 50")
def _(spark, d):
    spec = FilterSpec(latitude=46.9, longitude=7.4, radius_km=25, limit=50)
    return page(gate(ds.listings(spark, d), spec), spec).select("listing_id", F.round("distance_km", 6).alias("distance_km"))


def _landmark_distances(spark, d):
    own = ds.listings(spark, d).where("latitude IS NOT NULL").select("listing_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return sg.distances(own, ds.landmarks(spark, d), NEAR_M / 1000).select("listing_id", F.col("landmark").alias("landmark_key"), (F.col("dist_km") * 1000).alias("dist_m"))


@query("gate_any_of_landmark", ds.sql_with(listings=(ds.LISTINGS, "part"), landmarks=(ds.LANDMARKS, "nation")) + f" SELECT listing_id FROM listings WHERE EXISTS (SELECT 1 FROM landmarks WHERE landmark IN (SELECT n_name FROM nation WHERE n_nationkey < 6) AND {ds.km('latitude', 'longitude', 'tlat', 'tlon')} * 1000 < 3000)")
def _(spark, d):
    keys = [r["n_name"] for r in ds.table(spark, d, "nation").where("n_nationkey < 6").collect()]  # six names at most
    return gate(ds.listings(spark, d), FilterSpec(near_landmarks=keys), _landmark_distances(spark, d)).select("listing_id")


@query("gate_sort_nulls_last_page", f"{ds.L} SELECT listing_id, price FROM listings WHERE canton = 'C1' ORDER BY price DESC NULLS LAST, listing_id LIMIT 30 OFFSET 10")
def _(spark, d):
    spec = FilterSpec(canton="c1", sort_by="price_desc", limit=30, offset=10)
    return page(gate(ds.listings(spark, d), spec), spec).select("listing_id", "price")


@query("gate_map_points", f"{ds.L} SELECT listing_id, latitude, longitude, price, area FROM listings WHERE rooms >= 10 AND latitude IS NOT NULL")
def _(spark, d):
    return map_points(ds.listings(spark, d), FilterSpec(min_rooms=10))


@query("gate_postal_year", f"{ds.L} SELECT listing_id, year_built FROM listings WHERE postal_code IN (1003, 1007, 1040) AND year_built BETWEEN 1960 AND 2000")
def _(spark, d):
    return gate(ds.listings(spark, d), FilterSpec(postal_code=[1003, 1007, 1040]).merged(FilterSpec(min_year_built=1960, max_year_built=2000))).select("listing_id", "year_built")


@query("gate_bad_data", f"{ds.L}, x AS (SELECT listing_id, CASE listing_id % 5 WHEN 0 THEN 150 WHEN 1 THEN 60000 WHEN 2 THEN 0 ELSE price END AS price, CASE WHEN listing_id % 4 = 0 THEN 0 ELSE rooms END AS rooms, CASE WHEN listing_id % 6 = 0 THEN 0 ELSE latitude END AS latitude, CASE WHEN listing_id % 6 = 0 THEN 0 WHEN listing_id % 7 = 0 THEN longitude + 5 ELSE longitude END AS longitude FROM listings) SELECT listing_id, coalesce((price > 0 AND price < 200) OR price > 50000, FALSE) AS bad_price, coalesce(rooms = 0, FALSE) AS bad_rooms, coalesce(latitude = 0 AND longitude = 0, FALSE) AS nowhere, coalesce(latitude BETWEEN 45.8 AND 47.9 AND longitude BETWEEN 5.9 AND 10.5, FALSE) AS inside FROM x")
def _(spark, d):
    n = F.col("listing_id")
    own = ds.listings(spark, d).withColumns({
        "price": F.when(n % 5 == 0, 150).when(n % 5 == 1, 60000).when(n % 5 == 2, 0).otherwise(F.col("price")),
        "rooms": F.when(n % 4 == 0, 0).otherwise(F.col("rooms")),
        "latitude": F.when(n % 6 == 0, 0.0).otherwise(F.col("latitude")),
        "longitude": F.when(n % 6 == 0, 0.0).when(n % 7 == 0, F.col("longitude") + 5).otherwise(F.col("longitude")),
    })
    return own.select("listing_id", bad_price().alias("bad_price"), bad_rooms().alias("bad_rooms"), null_island().alias("nowhere"), inside().alias("inside"))


@query("gate_enriched_canton", f"{ds.L}, e AS (SELECT listing_id, 'C1' AS canton_filled, CASE WHEN listing_id % 7 = 0 THEN 'UNKNOWN' ELSE 'rev_geo_offline' END AS canton_source FROM listings WHERE listing_id % 2 = 0) SELECT listing_id FROM e WHERE canton_filled = 'C1' AND canton_source = 'rev_geo_offline'")
def _(spark, d):
    own = ds.listings(spark, d)
    enriched = own.where("listing_id % 2 = 0").select("listing_id", F.lit("C1").alias("canton_filled"), F.when(F.col("listing_id") % 7 == 0, "UNKNOWN").otherwise("rev_geo_offline").alias("canton_source"))
    return gate(with_enriched(own, enriched), FilterSpec(canton=" c1")).select("listing_id")


@query("join_left_enriched", f"{ds.L}, e AS (SELECT listing_id, 'C9' AS f, 'rev_geo_offline' AS s FROM listings WHERE listing_id % 3 = 0) SELECT l.listing_id, CASE WHEN l.listing_id % 3 = 0 THEN 'C9' END AS canton FROM listings l")
def _(spark, d):
    own = ds.listings(spark, d)
    enriched = own.where("listing_id % 3 = 0").select("listing_id", F.lit("C9").alias("canton_filled"), F.lit("rev_geo_offline").alias("canton_source"))
    return with_enriched(own, enriched).select("listing_id", "canton")


_CITIES = ["zurich", "geneva", "bern", "st-gallen"]


@query("gate_city_spellings", f"{ds.L} SELECT listing_id FROM listings WHERE listing_id % 4 IN (0, 1, 3)")
def _(spark, d):
    own = ds.listings(spark, d).withColumn("city_slug", F.get(F.array(*map(F.lit, _CITIES)), (F.col("listing_id") % 4).cast("int")))
    return gate(own, FilterSpec(city=[" Z\u00fcrich", "Gen\u00e8ve", "ZURICH", "St. Gallen", "  "])).select("listing_id")


@query("gate_filter_merge", f"{ds.L} SELECT listing_id, price FROM listings WHERE canton = 'C2' AND price <= 1700 ORDER BY price NULLS LAST, listing_id LIMIT 25 OFFSET 10")
def _(spark, d):
    spec = FilterSpec(canton="c2", sort_by="price_asc", limit=25, offset=10).merged(FilterSpec(max_price=1700))
    return page(gate(ds.listings(spark, d), spec), spec).select("listing_id", "price")


# --- joins


@query("join_left_signals", ds.sql_with(listings=(ds.LISTINGS, "part"), signals=(ds.SIGNALS, "customer")) + " SELECT l.listing_id, l.price, s.stop_m, coalesce(s.plausibility, 'none') AS plausibility FROM listings l LEFT JOIN signals s ON l.listing_id = s.listing_id")
def _(spark, d):
    s = ds.signals(spark, d).select("listing_id", "stop_m", "plausibility")
    return ds.listings(spark, d).join(s, "listing_id", "left").select("listing_id", "price", "stop_m", F.coalesce("plausibility", F.lit("none")).alias("plausibility"))


@query("join_semi_in_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    own = ds.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ds.table(spark, d, "orders").join(own, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("join_anti_dismissed", f"{ds.LE} SELECT listing_id FROM listings WHERE listing_id NOT IN (SELECT listing_id FROM ev WHERE kind = 'dismiss' AND listing_id IS NOT NULL)")
def _(spark, d):
    return ds.listings(spark, d).select("listing_id").join(ds.events(spark, d).where("kind = 'dismiss'").select("listing_id"), "listing_id", "left_anti")


@query("join_self_parent", "SELECT a.s_suppkey, coalesce(b.s_suppkey, a.s_suppkey) AS station FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = CASE WHEN a.s_suppkey % 3 = 0 THEN a.s_suppkey / 3 END")
def _(spark, d):
    a = ds.table(spark, d, "supplier").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey DIV 3 END").alias("parent"))
    b = ds.table(spark, d, "supplier").select(F.col("s_suppkey").alias("parent"), F.col("s_suppkey").alias("station"))
    return a.join(b, "parent", "left").select("s_suppkey", F.coalesce("station", "s_suppkey").alias("station"))


@query("join_nearest_k1", f"{ds.G}, r AS (SELECT id, target_id, {ds.km('lat', 'lon', 'tlat', 'tlon')} AS k FROM points, stops) SELECT id, min_by(target_id, k) AS target_id, round(min(k), 6) AS dist_km FROM r GROUP BY id")
def _(spark, d):
    return sg.nearest(ds.points(spark, d), ds.stops(spark, d)).select("id", "target_id", F.round("dist_km", 6).alias("dist_km"))


@query("join_radius_count", f"{ds.G} SELECT id, count(*) FILTER (WHERE {ds.km('lat', 'lon', 'tlat', 'tlon')} <= 30) AS n FROM points, stops GROUP BY id")
def _(spark, d):
    return sg.radius_count(ds.points(spark, d), ds.stops(spark, d), 30.0)


@query("join_cross_distance_cutoff", f"{ds.G} SELECT id, target_id, round({ds.km('lat', 'lon', 'tlat', 'tlon')}, 6) AS dist_km FROM points, landmarks WHERE {ds.km('lat', 'lon', 'tlat', 'tlon')} <= 40")
def _(spark, d):
    return sg.distances(ds.points(spark, d), ds.landmarks(spark, d), 40.0).select("id", "target_id", F.round("dist_km", 6).alias("dist_km"))


_SEGMENTS = [*ds.STOPS, f"{ds.LAT.format(k='(s_suppkey + 31)')} + 0.05 AS lat2", f"{ds.LON.format(k='(s_suppkey + 31)')} + 0.03 AS lon2"]
_SEG_T = "greatest(0.0, least(1.0, (px * dx + py * dy) / (dx * dx + dy * dy)))"


@query(
    "join_nearest_line_capped",
    ds.sql_with(points=(ds.POINTS, "customer"), seg=([x.replace("+ 0.05", "+ CAST(0.05 AS DOUBLE)").replace("+ 0.03", "+ CAST(0.03 AS DOUBLE)") for x in _SEGMENTS], "supplier"))
    + f", m AS (SELECT id, (lon - tlon) * cos(radians(lat)) AS px, lat - tlat AS py, (lon2 - tlon) * cos(radians(lat)) AS dx, lat2 - tlat AS dy FROM points, seg), x AS (SELECT id, sqrt(pow(px - {_SEG_T} * dx, 2) + pow(py - {_SEG_T} * dy, 2)) * 111.195 AS k FROM m) SELECT id, round(min(k) FILTER (WHERE k <= 5), 6) AS dist_km FROM x GROUP BY id",
)
def _(spark, d):
    seg = ds.project(spark, d, "supplier", [x.replace("+ 0.05", "+ CAST(0.05 AS DOUBLE)").replace("+ 0.03", "+ CAST(0.03 AS DOUBLE)") for x in _SEGMENTS])
    seg = seg.select(F.col("tlat").alias("lat1"), F.col("tlon").alias("lon1"), "lat2", "lon2")
    return sg.nearest_line(ds.points(spark, d), seg).select("id", F.round("dist_km", 6).alias("dist_km"))


@query("join_rounded_key", f"{ds.G} SELECT p.id, s.target_id FROM points p JOIN stops s ON round(p.lat * 10) = round(s.tlat * 10) AND round(p.lon * 10) = round(s.tlon * 10)")
def _(spark, d):
    key = lambda c: F.round(F.col(c) * 10)
    p = ds.points(spark, d).select("id", key("lat").alias("a"), key("lon").alias("b"))
    s = ds.stops(spark, d).select("target_id", key("tlat").alias("a"), key("tlon").alias("b"))
    return p.join(s, ["a", "b"]).select("id", "target_id")


@query("join_three_way_inner", "SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 200000")
def _(spark, d):
    t = lambda n: ds.table(spark, d, n)
    out = t("orders").where("o_totalprice > 200000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("o_orderkey", "n_name", "r_name")


# --- aggregations

_BUCKETS = "SELECT o_totalprice AS price, c_nationkey AS canton, o_orderpriority AS rooms, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey"


def _bucketed(spark, d):
    return ds.table(spark, d, "orders").join(ds.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_totalprice").alias("price"), F.col("c_nationkey").alias("canton"), F.col("o_orderpriority").alias("rooms"), "o_orderkey")


@query("agg_median_bucket", f"SELECT canton, rooms, round(median(price), 4) AS baseline, count(*) AS n FROM ({_BUCKETS}) WHERE price > 0 GROUP BY canton, rooms HAVING count(*) >= 5")
def _(spark, d):
    return sg.price_baselines(_bucketed(spark, d), ["canton", "rooms"], digits=4)


@query("agg_price_delta_plausibility", f"WITH b AS ({_BUCKETS}), m AS (SELECT canton, rooms, round(median(price), 2) AS baseline FROM b WHERE price > 0 GROUP BY canton, rooms HAVING count(*) >= 5), x AS (SELECT o_orderkey, (price - baseline) / baseline AS r FROM b LEFT JOIN m USING (canton, rooms)) SELECT o_orderkey, round(r, 4) AS delta, CASE WHEN r IS NULL THEN NULL WHEN abs(round(r, 4)) > 3 THEN 'suspect' ELSE 'normal' END AS plausibility FROM x")
def _(spark, d):
    own, keys = _bucketed(spark, d), ["canton", "rooms"]
    out = sg.price_delta(own, sg.price_baselines(own, keys), keys, "delta")
    return out.select("o_orderkey", "delta", sg.plausibility(F.col("delta")).alias("plausibility"))


@query("agg_rooms_bucket", f"{ds.L} SELECT listing_id, CASE WHEN floor(rooms * 2 + 0.5) / 2 > 0 AND floor(rooms * 2 + 0.5) / 2 <= 15 THEN floor(rooms * 2 + 0.5) / 2 END AS bucket, substr(CAST(postal_code AS STRING), 1, 2) AS plz2 FROM listings")
def _(spark, d):
    return ds.listings(spark, d).select("listing_id", sg.rooms_bucket(F.col("rooms")).alias("bucket"), F.substring(F.col("postal_code").cast("string"), 1, 2).alias("plz2"))


@query("agg_majority_vote_conf", "WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM c) SELECT c_nationkey, c_mktsegment, n, CAST(total AS BIGINT) AS total, CAST(CASE WHEN n = total AND total >= 5 THEN 0.85 WHEN n / total >= 0.95 AND total >= 5 THEN 0.75 WHEN n / total >= 0.95 AND total <= 3 THEN 0.65 WHEN n / total >= 0.75 THEN 0.60 ELSE 0.45 END AS DOUBLE) AS confidence FROM t WHERE rn = 1")
def _(spark, d):
    return sg.majority(ds.table(spark, d, "customer"), "c_nationkey", "c_mktsegment").withColumn("confidence", F.col("confidence").cast("double"))


_VOTES = "SELECT CAST(o_custkey AS BIGINT) AS plz, CASE WHEN o_custkey % 3 = 0 OR o_orderkey % (o_custkey % 30 + 2) > 0 THEN 'A' ELSE o_orderstatus END AS canton FROM orders"


@query("agg_vote_ladder", f"WITH v AS ({_VOTES}), c AS (SELECT plz, canton, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY plz) AS total, row_number() OVER (PARTITION BY plz ORDER BY n DESC, canton) AS rn FROM c) SELECT plz, canton, n, CAST(total AS BIGINT) AS total, CAST(CASE WHEN n / total >= 1 AND total >= 5 THEN 0.85 WHEN n / total >= 0.95 AND total >= 5 THEN 0.75 WHEN n / total >= 0.95 AND total <= 3 THEN 0.65 WHEN n / total >= 0.75 THEN 0.60 ELSE 0.45 END AS DOUBLE) AS confidence FROM t WHERE rn = 1")
def _(spark, d):
    own = ds.table(spark, d, "orders").selectExpr("CAST(o_custkey AS BIGINT) AS plz", _VOTES.split(" AS plz, ")[1].split(" FROM ")[0])
    return sg.majority(own, "plz", "canton").withColumn("confidence", F.col("confidence").cast("double"))


@query("agg_distinct_and_mode", "WITH m AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag DESC) AS rn FROM m), c AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS lines FROM lineitem GROUP BY 1) SELECT c.l_suppkey AS stop_id, lines, l_returnflag AS mode FROM c JOIN x ON c.l_suppkey = x.l_suppkey WHERE rn = 1")
def _(spark, d):
    li = ds.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    lines = li.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("lines"))
    mode = li.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("n", "l_returnflag")).alias("mode"))
    return lines.join(mode, "l_suppkey").select(F.col("l_suppkey").alias("stop_id"), "lines", "mode")


@query("agg_percentiles", "SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75, quantile_cont(o_totalprice, 0.9) AS p90 FROM orders GROUP BY 1".replace("quantile_cont(o_totalprice, 0.", "round(quantile_cont(o_totalprice, 0.").replace(") AS p", "), 6) AS p").replace("SELECT o_orderpriority, round", "SELECT o_orderpriority, round"))
def _(spark, d):
    p = audit.percentiles(ds.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return p.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in p.columns[1:]])


@query("agg_histogram_bins", "WITH h AS (SELECT CAST(least(floor(l_discount * 10 * 10), 9) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_discount * 10 BETWEEN 0 AND 1 GROUP BY 1) SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM range(10) t(b) LEFT JOIN h ON h.bin = b")
def _(spark, d):
    return audit.histogram(ds.table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("c")), "c")


@query("agg_log_histogram", "SELECT CAST(floor(log10(o_totalprice)) AS INT) AS magnitude, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def _(spark, d):
    return audit.log_histogram(ds.table(spark, d, "orders"), "o_totalprice")


@query("agg_conditional_coverage", f"{ds.L} SELECT 'price' AS field, count(price) AS filled, count(*) AS total FROM listings UNION ALL SELECT 'rooms', count(rooms), count(*) FROM listings UNION ALL SELECT 'object_category', count(object_category), count(*) FROM listings UNION ALL SELECT 'latitude', count(latitude), count(*) FROM listings")
def _(spark, d):
    return audit.coverage(ds.listings(spark, d), ["price", "rooms", "object_category", "latitude"])


_FIELDS = ["city_slug", "object_category", "price", "year_built"]


def _state(spark, d):
    return enrich.seed(ds.listings(spark, d), _FIELDS)


_STATE_SQL = ds.L + ", state AS (" + " UNION ALL ".join(f"SELECT listing_id, '{f}' AS field, coalesce(CAST({f} AS STRING), 'UNKNOWN') AS filled, CASE WHEN {f} IS NULL THEN 'UNKNOWN-pending' ELSE 'original' END AS source, CASE WHEN {f} IS NULL THEN 0.0 ELSE 1.0 END AS confidence FROM listings" for f in ("city_slug", "object_category", "price", "year_built")) + ")"


@query("agg_unpivot_sources", f"{_STATE_SQL} SELECT field, source, count(*) AS n FROM state GROUP BY 1, 2")
def _(spark, d):
    return audit.sources(_state(spark, d))


@query("agg_isochrone_curve", f"{ds.S}, c AS (SELECT CAST(greatest(1, ceil(commute_proxy_min)) AS INT) AS t, count(*) AS n FROM signals WHERE commute_proxy_min <= 90 GROUP BY 1) SELECT CAST(b AS INT) AS t, CAST(sum(coalesce(n, 0)) OVER (ORDER BY b) AS BIGINT) AS reachable FROM range(1, 91) r(b) LEFT JOIN c ON c.t = b")
def _(spark, d):
    return audit.isochrone(ds.signals(spark, d), "commute_proxy_min")


@query("agg_having_integrity", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def _(spark, d):
    return audit.repeated(ds.table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("agg_reach_by_landmark", f"{ds.G}, r AS (SELECT landmark, {ds.km('lat', 'lon', 'tlat', 'tlon')} AS k FROM points, landmarks) SELECT landmark, count(*) AS n, round(avg(k), 6) AS mean_km FROM r WHERE k <= 40 GROUP BY 1")
def _(spark, d):
    out = sg.distances(ds.points(spark, d), ds.landmarks(spark, d), 40.0).groupBy("landmark")
    return out.agg(F.count("*").alias("n"), F.round(F.avg("dist_km"), 6).alias("mean_km"))


@query("agg_column_profile", "SELECT count(*) AS rows, count(*) FILTER (WHERE event_type IS NULL) AS nulls, count(DISTINCT event_type) AS distinct_values, CASE WHEN bool_and(regexp_full_match(event_type, '-?[0-9]+')) THEN 'int' WHEN bool_and(regexp_full_match(event_type, '-?[0-9]+(\\.[0-9]+)?')) THEN 'float' ELSE 'text' END AS class, min(event_type) AS least, max(event_type) AS greatest, avg(TRY_CAST(event_type AS DOUBLE)) AS mean FROM events")
def _(spark, d):
    return audit.profile(ds.table(spark, d, "events"), "event_type")


@query("agg_profile_numbers", "SELECT count(*) AS rows, count(*) FILTER (WHERE s IS NULL) AS nulls, count(DISTINCT s) AS distinct_values, CASE WHEN bool_and(regexp_full_match(s, '-?[0-9]+')) THEN 'int' ELSE 'other' END AS class, min(s) AS least, max(s) AS greatest, round(avg(TRY_CAST(s AS DOUBLE)), 6) AS mean FROM (SELECT CASE WHEN p_partkey % 9 > 0 THEN CAST(p_size AS VARCHAR) END AS s FROM part)")
def _(spark, d):
    own = ds.table(spark, d, "part").select(F.when(F.col("p_partkey") % 9 > 0, F.col("p_size").cast("string")).alias("s"))
    return audit.profile(own, "s").withColumn("mean", F.round("mean", 6))


@query("agg_top_values", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 4")
def _(spark, d):
    return audit.top_values(ds.table(spark, d, "part"), "p_type", 4)


@query("agg_coverage_lift", f"{_STATE_SQL} SELECT 'object_category' AS field, (SELECT count(object_category) FROM listings) AS raw, (SELECT count(*) FROM state WHERE field = 'object_category' AND source = 'original') + (SELECT count(*) FROM listings WHERE object_category IS NULL AND listing_id % 4 = 0) AS enriched, (SELECT count(*) FROM listings) AS total UNION ALL SELECT 'year_built', (SELECT count(year_built) FROM listings), (SELECT count(year_built) FROM listings), (SELECT count(*) FROM listings) UNION ALL SELECT 'cellar', 0, 0, (SELECT count(*) FROM listings)")
def _(spark, d):
    own = ds.listings(spark, d)
    proposals = own.where("listing_id % 4 = 0").selectExpr("listing_id", "'object_category' AS field", "'apartment' AS value", "'text' AS by", "CAST(0.8 AS DOUBLE) AS sure", "'Wohnung' AS said")
    done = enrich.sentinel_fill(enrich.overlay(_state(spark, d), proposals))
    return audit.lift(own, done, ["object_category", "year_built", "cellar"])


@query("agg_answerable", ds.sql_with(listings=(ds.LISTINGS, "part"), signals=(ds.SIGNALS, "customer")) + ", m AS (SELECT l.*, s.stop_m, s.schools FROM listings l LEFT JOIN signals s USING (listing_id)) SELECT 'year built after 2000' AS question, count(year_built) AS n, count(*) AS total, round(count(year_built) / count(*), 9) AS share FROM m UNION ALL SELECT 'stop within 300 m', count(stop_m), count(*), round(count(stop_m) / count(*), 9) FROM m UNION ALL SELECT 'three schools', count(schools), count(*), round(count(schools) / count(*), 9) FROM m")
def _(spark, d):
    met = ds.listings(spark, d).join(ds.signals(spark, d).select("listing_id", "stop_m", "schools"), "listing_id", "left")
    out = audit.answerable(met, {"year built after 2000": F.col("year_built").isNotNull(), "stop within 300 m": F.col("stop_m").isNotNull(), "three schools": F.col("schools").isNotNull()})
    return out.withColumn("share", F.round("share", 9))


@query("agg_gazetteer_kinds", "SELECT CASE WHEN n_regionkey < 2 THEN 'lake' ELSE 'transit' END AS kind, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    gazetteer = ds.table(spark, d, "nation").select(F.when(F.col("n_regionkey") < 2, "lake").otherwise("transit").alias("kind"))
    return audit.scatter(ds.listings(spark, d), gazetteer, {"latitude": (45, 48)})[0]


@query("agg_scatter_box", f"{ds.L} SELECT listing_id FROM listings WHERE latitude BETWEEN 46 AND 47 AND longitude BETWEEN 6.5 AND 9")
def _(spark, d):
    gazetteer = ds.table(spark, d, "nation").select(F.lit("k").alias("kind"))
    return audit.scatter(ds.listings(spark, d), gazetteer, {"latitude": (46, 47), "longitude": (6.5, 9)})[1].select("listing_id")


_STORE = "im AS (SELECT vec_id AS image_id, CASE WHEN vec_id % 4 = 0 THEN 'floorplan' WHEN vec_id % 9 = 0 THEN 'dropped' ELSE 'main' END AS index_kind, label, embedding FROM embeddings)"


@query("image_store_checks", f"WITH {_STORE}, v AS (SELECT * FROM im WHERE index_kind <> 'dropped' AND image_id % 10 <> 1) SELECT 'rows_on_disk' AS check, abs(count(*) - 480) AS bad FROM im UNION ALL SELECT 'labels_main', count(*) FILTER (WHERE index_kind = 'main' AND label > 7) FROM im UNION ALL SELECT 'labels_floorplan', count(*) FILTER (WHERE index_kind = 'floorplan' AND label > 2) FROM im UNION ALL SELECT 'labels_dropped', count(*) FILTER (WHERE index_kind = 'dropped' AND label <> 9) FROM im UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT image_id) FROM im UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE list_sum(list_transform(embedding, lambda x: CAST(isnan(x) OR isinf(x) AS INT))) > 0) FROM v UNION ALL SELECT 'not_unit', count(*) FILTER (WHERE sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) NOT BETWEEN 0.99 AND 1.01) FROM v UNION ALL SELECT 'rows_' || k, (SELECT count(*) FROM im WHERE index_kind = k) - (SELECT count(*) FROM v WHERE index_kind = k) FROM (SELECT unnest(['main', 'floorplan']) AS k)")
def _(spark, d):
    n = F.col("vec_id")
    own = ds.table(spark, d, "embeddings").select(n.alias("image_id"), F.when(n % 4 == 0, "floorplan").when(n % 9 == 0, "dropped").otherwise("main").alias("index_kind"), "label", "embedding")
    vectors = own.where("index_kind <> 'dropped' AND image_id % 10 <> 1")
    return audit.store_checks(own.drop("embedding"), vectors, {"main": [str(i) for i in range(8)], "floorplan": ["0", "1", "2"], "dropped": ["9"]}, 480)


@query("agg_vector_integrity", "SELECT count(*) AS rows, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size, CAST(0 AS BIGINT) AS not_finite, count(*) FILTER (WHERE sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) NOT BETWEEN 0.99 AND 1.01) AS not_unit, count(*) - count(DISTINCT vec_id) AS repeated_ids FROM embeddings")
def _(spark, d):
    return audit.vector_checks(ds.table(spark, d, "embeddings"), 64)


@query("agg_first_examples_per_label", "SELECT label, vec_id, CAST(rn AS INT) AS place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 5")
def _(spark, d):
    return audit.first_examples(ds.table(spark, d, "embeddings"), "label", "vec_id")


# --- windows


@query("win_latest_event_wins", f"{ds.E} SELECT user_id, listing_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id, listing_id ORDER BY created_at DESC, id DESC) AS rn FROM ev WHERE kind IN ('dismiss', 'undismiss')) WHERE rn = 1")
def _(spark, d):
    return memory.latest(ds.events(spark, d), ["dismiss", "undismiss"])


@query("win_stratified_sample", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 7")
def _(spark, d):
    return audit.first_examples(ds.table(spark, d, "customer"), "c_nationkey", "c_custkey", 7).drop("place")


@query("win_nearest_k_landmarks", f"{ds.G}, r AS (SELECT id, target_id, {ds.km('lat', 'lon', 'tlat', 'tlon')} AS k FROM points, landmarks), x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, target_id) AS rn FROM r) SELECT id, target_id, CAST(rn AS INT) AS place FROM x WHERE rn <= 5")
def _(spark, d):
    return sg.nearest_k(ds.points(spark, d), ds.landmarks(spark, d)).select("id", "target_id", "place")


# --- vectors

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


@query("topk_vector_cosine", f"SELECT e.vec_id, round({_dot('e.embedding', 'q.embedding')}, 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY score DESC, e.vec_id LIMIT 20")
def _(spark, d):
    v = ds.table(spark, d, "embeddings")
    q = F.broadcast(v.where("vec_id = 7").select(F.col("embedding").alias("q")))
    return v.crossJoin(q).select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


_CENTROID = "SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL"


@query("vec_centroid_by_label", f"WITH c AS ({_CENTROID}) SELECT label, CAST(i AS INT) AS i, round(m, 9) AS m FROM c")
def _(spark, d):
    c = memory.centroid(ds.table(spark, d, "embeddings"), ["label"])
    return c.select("label", F.posexplode("vector").alias("i", "m")).select("label", (F.col("i") + 1).alias("i"), F.round("m", 9).alias("m"))


@query("vec_centroid_similar", f"WITH own AS (SELECT list(m ORDER BY i) AS c FROM ({_CENTROID}) WHERE label = 3), s AS (SELECT vec_id // 5 AS listing_id, {_dot('embedding', 'c')} / sqrt({_dot('c', 'c')}) AS s FROM embeddings, own WHERE label <> 3) SELECT listing_id, round(max(s), 9) AS score FROM s GROUP BY 1 ORDER BY score DESC, listing_id LIMIT 25")
def _(spark, d):
    v = ds.table(spark, d, "embeddings")
    c = F.broadcast(memory.centroid(v.where("label = 3"), ["label"]).select(F.col("vector").alias("c")))
    s = v.where("label <> 3").crossJoin(c).select(F.expr("vec_id DIV 5").alias("listing_id"), (dot(F.col("embedding"), F.col("c")) / norm(F.col("c"))).alias("s"))
    return s.groupBy("listing_id").agg(F.round(F.max("s"), 9).alias("score")).orderBy(F.desc("score"), "listing_id").limit(25)


@query("vec_maxpool_listing", f"WITH s AS (SELECT e.vec_id // 5 AS listing_id, e.vec_id AS image_id, {_dot('e.embedding', 'q.embedding')} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 11) SELECT listing_id, round(max(s), 9) AS score, arg_max(image_id, s) AS image_id FROM s GROUP BY 1")
def _(spark, d):
    v = ds.table(spark, d, "embeddings")
    images = v.select(F.expr("vec_id DIV 5").alias("listing_id"), F.col("vec_id").alias("image_id"), "embedding")
    return search.best_per_listing(images, v.where("vec_id = 11")).select("listing_id", F.round("score", 9).alias("score"), "image_id")


@query("vec_gem_pool", "WITH g AS (SELECT vec_id // 5 AS listing_id, i, pow(avg(pow(greatest(CAST(embedding[i] AS DOUBLE), 1e-6), 3)), 1.0 / 3) AS g FROM embeddings, range(1, 65) r(i) GROUP BY 1, i), n AS (SELECT listing_id, sqrt(sum(g * g)) AS n FROM g GROUP BY 1) SELECT listing_id, CAST(i AS INT) AS i, round(g / n, 9) AS g FROM g JOIN n USING (listing_id)")
def _(spark, d):
    v = ds.table(spark, d, "embeddings").select(F.expr("vec_id DIV 5").alias("listing_id"), "embedding")
    return memory.gem(v, ["listing_id"]).select("listing_id", F.posexplode("vector").alias("i", "g")).select("listing_id", (F.col("i") + 1).alias("i"), F.round("g", 9).alias("g"))


@query("feature_similarity", f"{ds.L}, b AS (SELECT canton AS bc, object_category AS bo, rooms AS br, price AS bp FROM listings WHERE listing_id = 3) SELECT listing_id, round(coalesce(CAST(canton = bc AS INT), 0) * 2.0 + coalesce(CAST(object_category = bo AS INT), 0) * 0.5 + CASE WHEN br IS NULL OR bp IS NULL OR bp = 0 THEN 0 ELSE 1 / (1 + abs(coalesce(rooms, 0) - br)) + CASE WHEN price > 0 THEN 1 / (1 + abs(price - bp) / bp) ELSE 0 END END, 9) AS score FROM listings, b WHERE listing_id <> 3 ORDER BY score DESC, listing_id LIMIT 50")
def _(spark, d):
    own = ds.listings(spark, d)
    base = F.broadcast(own.where("listing_id = 3").select(F.col("canton").alias("bc"), F.col("object_category").alias("bo"), F.col("rooms").alias("br"), F.col("price").alias("bp")))
    s = ranking.feature_similarity(F.col("canton") == F.col("bc"), F.col("object_category") == F.col("bo"), F.col("rooms"), F.col("br"), F.col("price"), F.col("bp"))
    return own.where("listing_id <> 3").crossJoin(base).select("listing_id", F.round(s, 9).alias("score")).orderBy(F.desc("score"), "listing_id").limit(50)


# --- lexical and hybrid search

_TERMS = ["the", "with that", "\"from\""]
_TOK = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
_BM25 = f"""tok AS (SELECT doc_id, {_TOK} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
hits AS (SELECT doc_id, 0 AS p, len(list_filter(t, lambda x: x = 'the')) AS tf, len(t) AS dl FROM tok
  UNION ALL SELECT doc_id, 1, len(list_filter(range(1, len(t)), lambda i: t[i] = 'with' AND t[i + 1] = 'that')), len(t) FROM tok
  UNION ALL SELECT doc_id, 2, len(list_filter(t, lambda x: x = 'from')), len(t) FROM tok),
h AS (SELECT * FROM hits WHERE tf > 0), dfs AS (SELECT p, count(*) AS df FROM h GROUP BY p),
bm AS (SELECT doc_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN dfs USING (p), st GROUP BY doc_id)"""


def _docs(spark, d):
    return ds.table(spark, d, "documents").withColumnRenamed("doc_id", "listing_id")


_indexes: dict[tuple[str, str], str] = {}


def _index(spark, d) -> bm25.Index:
    """The documents' stored index, built once a session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _indexes:
        path = new_path(spark, "bm25")
        bm25.build(_docs(spark, d), "listing_id", ["text"], path)
        _indexes[at] = path
    return bm25.Index(spark, _indexes[at])


@query("bm25_index_build", f"WITH tok AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS places FROM tok GROUP BY 1")
def _(spark, d):
    path = new_path(spark, "bm25")
    bm25.build(_docs(spark, d), "listing_id", ["text"], path)
    return bm25.Index(spark, path).postings.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("places")).alias("places"))


@query("bm25_or_phrases", f"WITH {_BM25} SELECT doc_id AS listing_id, round(score, 9) AS score FROM bm")
def _(spark, d):
    return _index(spark, d).score(_TERMS).select("listing_id", F.round("score", 9).alias("score"))


@query("bm25_scan", f"WITH {_BM25} SELECT doc_id AS listing_id, round(score, 9) AS score FROM bm")
def _(spark, d):
    return bm25.score(_docs(spark, d), "listing_id", ["text"], _TERMS).select("listing_id", F.round("score", 9).alias("score"))


@query("bm25_gated_coalesce", f"WITH {_BM25} SELECT d.doc_id AS listing_id, round(coalesce(score, 1e9), 9) AS bm25 FROM documents d LEFT JOIN bm ON bm.doc_id = d.doc_id WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 8000 ORDER BY coalesce(score, 1e9), d.doc_id LIMIT 300")
def _(spark, d):
    gated = _docs(spark, d).where("lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 8000").select("listing_id")
    return search.pool(gated, _index(spark, d).score(_TERMS), 20).select("listing_id", F.round("bm25", 9).alias("bm25"))


_HYBRID = f"""WITH {_BM25},
pool AS (SELECT *, row_number() OVER (ORDER BY s, doc_id) AS pos FROM (SELECT d.doc_id, n_chars, coalesce(score, 1e9) AS s FROM documents d LEFT JOIN bm ON bm.doc_id = d.doc_id WHERE lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 8000 ORDER BY s, d.doc_id LIMIT 300)),
dense AS (SELECT doc_id, row_number() OVER (ORDER BY {_dot('e.embedding', 'q.embedding')} DESC, pos) AS r FROM pool JOIN embeddings e ON e.vec_id = doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 7) q),
soft AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, pos) AS r FROM pool),
f AS (SELECT doc_id, sum(1.0 / (60 + r)) AS rrf FROM (SELECT doc_id, pos AS r FROM pool UNION ALL SELECT doc_id, r FROM dense UNION ALL SELECT doc_id, r FROM soft) GROUP BY doc_id)
SELECT f.doc_id AS listing_id, round(rrf, 9) AS rrf FROM f JOIN pool USING (doc_id) ORDER BY round(f.rrf, 12) DESC, pos LIMIT 20"""


@query("hybrid_search", _HYBRID)
def _(spark, d):
    docs = _docs(spark, d)
    gated = docs.where("lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 8000").select("listing_id", "n_chars")
    v = ds.vectors(spark, d)
    soft = lambda p: [ranking.rank_by(p, "short", F.col("n_chars"))]
    out = search.hybrid(gated, docs, ["text"], _TERMS, v, v.where("listing_id = 7"), soft, index=_index(spark, d))
    return out.select("listing_id", F.round("rrf", 9).alias("rrf"))


@query("rrf_nway", f"{ds.S}, a AS (SELECT listing_id, row_number() OVER (ORDER BY schools DESC, pool_pos) AS r FROM signals WHERE schools IS NOT NULL), b AS (SELECT listing_id, row_number() OVER (ORDER BY commute_proxy_min, pool_pos) AS r FROM signals WHERE commute_proxy_min IS NOT NULL) SELECT listing_id, round(sum(1.0 / (60 + r)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def _(spark, d):
    s = ds.signals(spark, d)
    out = ranking.rrf([ranking.rank_by(s, "schools", F.col("schools"), True), ranking.rank_by(s, "commute", F.col("commute_proxy_min"))])
    return out.select("listing_id", F.round("rrf", 9).alias("rrf"))


_LOOKALIKES = f"""{ds.L}, own AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) WHERE vec_id // 5 = 4 GROUP BY i)),
img AS (SELECT listing_id, row_number() OVER (ORDER BY s DESC, listing_id) AS r FROM (SELECT vec_id // 5 AS listing_id, max({_dot('embedding', 'c')}) AS s FROM embeddings, own GROUP BY 1) WHERE listing_id <> 4),
txt AS (SELECT e.vec_id AS listing_id, row_number() OVER (ORDER BY {_dot('e.embedding', 'q.embedding')} DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id = 4 AND e.vec_id <> 4 QUALIFY r <= 500),
fs AS (SELECT o.listing_id, coalesce(CAST(o.canton = b.canton AS DOUBLE), 0) * 2 + coalesce(CAST(o.object_category = b.object_category AS DOUBLE), 0) * CAST(0.5 AS DOUBLE) + CASE WHEN b.rooms IS NOT NULL AND b.price IS NOT NULL AND b.price <> 0 THEN CAST(1 AS DOUBLE) / (1 + abs(coalesce(o.rooms, 0) - b.rooms)) + CASE WHEN o.price > 0 THEN CAST(1 AS DOUBLE) / (1 + abs(o.price - b.price) / b.price) ELSE 0 END ELSE 0 END AS s FROM listings o, listings b WHERE b.listing_id = 4 AND o.listing_id <> 4),
feat AS (SELECT listing_id, row_number() OVER (ORDER BY s DESC, listing_id) AS r FROM fs QUALIFY r <= 500)
SELECT listing_id, round(sum(1.0 / (60 + r)), 9) AS rrf FROM (SELECT * FROM img UNION ALL SELECT * FROM txt UNION ALL SELECT * FROM feat) GROUP BY 1 ORDER BY round(sum(1.0 / (60 + r)), 12) DESC, listing_id LIMIT 10"""


@query("fused_lookalikes", _LOOKALIKES)
def _(spark, d):
    out = search.lookalikes(4, ds.listings(spark, d), _images(spark, d), ds.vectors(spark, d).select("listing_id", "embedding"))
    return out.select("listing_id", F.round("rrf", 9).alias("rrf"))


# --- soft rankings


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("listing_id", "rank")


def _rank_sql(value: str, order: str, where: str = "TRUE") -> str:
    return f"{ds.S} SELECT listing_id, CAST(row_number() OVER (ORDER BY v {order}, pool_pos) AS INT) AS rank FROM (SELECT listing_id, pool_pos, {value} AS v FROM signals WHERE {where}) WHERE v IS NOT NULL"


@query("soft_price", _rank_sql("coalesce(price_delta_canton, price_delta_plz)", "ASC", "plausibility IS DISTINCT FROM 'suspect'"))
def _(spark, d):
    return _ranked(ranking.soft_rankings(ds.signals(spark, d), price="cheap")[0])


@query("soft_quiet_sum_nonnull", _rank_sql("CASE WHEN motorway_m IS NOT NULL OR primary_m IS NOT NULL THEN coalesce(motorway_m, 0) + coalesce(primary_m, 0) END", "DESC"))
def _(spark, d):
    return _ranked(ranking.soft_rankings(ds.signals(spark, d), quiet=True)[0])


@query("soft_transit_composite", _rank_sql("CASE WHEN stop_m IS NOT NULL OR lines IS NOT NULL THEN round(coalesce(-stop_m / 1000, 0) + CASE WHEN lines IS NULL THEN 0 ELSE ln(1 + greatest(0, least(100, lines))) END, 9) END", "DESC"))
def _(spark, d):
    return _ranked(ranking.rank_by(ds.signals(spark, d), "transit", F.round(ranking.transit_value(), 9), True))


@query("soft_commute_fallback", f"{ds.S}, t AS (SELECT c_custkey AS listing_id, CAST(c_custkey % 70 AS INT) AS real_min FROM customer WHERE c_custkey % 3 = 1) SELECT listing_id, CAST(row_number() OVER (ORDER BY v, pool_pos) AS INT) AS rank FROM (SELECT s.listing_id, pool_pos, coalesce(CAST(real_min AS DOUBLE), commute_proxy_min) AS v FROM signals s LEFT JOIN t ON s.listing_id = t.listing_id) WHERE v IS NOT NULL")
def _(spark, d):
    travel = ds.table(spark, d, "customer").where("c_custkey % 3 = 1").select(F.col("c_custkey").alias("listing_id"), F.lit("hub").alias("landmark_key"), (F.col("c_custkey") % 70).cast("int").alias("travel_min"), F.lit(None).cast("double").alias("dist_m"))
    return _ranked(ranking.soft_rankings(ds.signals(spark, d), commute="hub", travel=travel)[0])


@query("soft_counts", _rank_sql("schools", "DESC"))
def _(spark, d):
    return _ranked(ranking.soft_rankings(ds.signals(spark, d), counts=("schools",))[0])


# --- memory

_W = "CASE WHEN kind = 'dwell' AND value >= 5 THEN 2.0 WHEN kind = 'bookmark' THEN 5.0 WHEN kind = 'like' THEN 3.0 WHEN kind = 'click' THEN 1.0 WHEN kind = 'dismiss' THEN -2.0 WHEN kind = 'undismiss' THEN 2.0 ELSE 0.0 END"
_WSQL = f"w AS (SELECT user_id, listing_id, CAST(sum({_W}) AS DOUBLE) AS weight, coalesce(max(CASE WHEN kind IN ('dismiss', 'undismiss') THEN concat(lpad(CAST(epoch_us(created_at) AS STRING), 20, '0'), lpad(CAST(id AS STRING), 12, '0'), ':', kind) END) LIKE '%:dismiss', FALSE) AS dismissed FROM ev GROUP BY 1, 2)"


def _weights(spark, d):
    return memory.weights(memory.recent(ds.events(spark, d), ds.AS_OF))


@query("mem_event_weights", f"{ds.E}, {_WSQL} SELECT user_id, listing_id, weight, dismissed FROM w")
def _(spark, d):
    return _weights(spark, d)


@query("mem_cold_start", f"{ds.E}, {_WSQL} SELECT user_id, count(*) FILTER (WHERE weight > 0) AS positives, count(*) FILTER (WHERE weight > 0) < 3 AS cold FROM w GROUP BY 1")
def _(spark, d):
    return memory.cold_start(_weights(spark, d))


_TASTE = " UNION ALL ".join(f"SELECT user_id, '{f}' AS feature, weight, {f} AS flag FROM w JOIN listings USING (listing_id) WHERE weight <> 0" for f in ("feature_balcony", "feature_elevator", "feature_parking"))
_TASTE_SQL = f"{ds.LE}, {_WSQL}, t AS ({_TASTE}), taste AS (SELECT user_id, feature, sum(weight * CASE WHEN flag = 1 THEN 1 ELSE -1 END) / sum(abs(weight)) AS taste FROM t WHERE flag IS NOT NULL GROUP BY 1, 2)"


def _taste(spark, d):
    return memory.feature_taste(_weights(spark, d), ds.listings(spark, d), ["feature_balcony", "feature_elevator", "feature_parking"])


@query("mem_feature_taste", f"{_TASTE_SQL} SELECT user_id, feature, round(taste, 9) AS taste FROM taste")
def _(spark, d):
    return _taste(spark, d).withColumn("taste", F.round("taste", 9))


@query("mem_summary_tags", f"{_TASTE_SQL}, s AS (SELECT *, CASE WHEN taste > 0 THEN 'liked' ELSE 'avoided' END AS side FROM taste WHERE abs(taste) >= 0.1), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY abs(taste) DESC, feature) AS rn FROM s) SELECT user_id, side, feature, round(taste, 3) AS taste FROM r WHERE rn <= 6")
def _(spark, d):
    return memory.tags(_taste(spark, d), 0.1)


_PRICE_SQL = f"{ds.LE}, {_WSQL}, ps AS (SELECT user_id, avg(ln(price)) AS mu, CASE WHEN count(*) = 1 THEN 0.3 ELSE greatest(stddev_samp(ln(price)), 0.05) END AS sigma FROM w JOIN listings USING (listing_id) WHERE weight > 0 AND price > 0 GROUP BY 1)"


def _stats(spark, d):
    return memory.price_stats(_weights(spark, d), ds.listings(spark, d))


@query("mem_price_stats", f"{_PRICE_SQL} SELECT user_id, round(mu, 9) AS mu, round(sigma, 9) AS sigma FROM ps")
def _(spark, d):
    return _stats(spark, d).select("user_id", F.round("mu", 9).alias("mu"), F.round("sigma", 9).alias("sigma"))


@query("mem_price_range", f"{_PRICE_SQL} SELECT user_id, round(exp(mu - sigma), 6) AS low, round(exp(mu), 6) AS typical, round(exp(mu + sigma), 6) AS high FROM ps")
def _(spark, d):
    return memory.price_range(_stats(spark, d)).select("user_id", *[F.round(c, 6).alias(c) for c in ("low", "typical", "high")])


@query("mem_price_rank", f"{_PRICE_SQL} SELECT listing_id, round(-abs(ln(price) - mu) / greatest(sigma, 0.05), 9) AS score FROM listings, ps WHERE user_id = 5 AND price > 0")
def _(spark, d):
    stats = F.broadcast(_stats(spark, d).where("user_id = 5"))
    return ds.listings(spark, d).crossJoin(stats).select("listing_id", F.round(memory.price_score(F.col("price"), F.col("mu"), F.col("sigma")), 9).alias("score")).where("score IS NOT NULL")


@query("mem_semantic_taste", f"WITH p AS (SELECT list(m ORDER BY i) AS v FROM ({_CENTROID}) WHERE label = 1), n AS (SELECT list(m ORDER BY i) AS v FROM ({_CENTROID}) WHERE label = 2), q AS (SELECT list_transform(range(1, 65), lambda i: p.v[i] - 0.5 * n.v[i]) AS q FROM p, n) SELECT vec_id AS listing_id, round({_dot('embedding', 'q')} / sqrt({_dot('q', 'q')}), 9) AS score FROM embeddings, q")
def _(spark, d):
    v = ds.vectors(spark, d)
    own = lambda n: v.where(F.col("label") == n).select("listing_id")
    return memory.semantic_taste(v, v, own(1), own(2)).withColumn("score", F.round("score", 9))


@query("mem_dismissal_demotion", f"WITH pool AS (SELECT e.vec_id AS listing_id, e.embedding, row_number() OVER (ORDER BY -{_dot('e.embedding', 'q.embedding')}, e.vec_id) AS pool_pos FROM embeddings e, embeddings q WHERE q.vec_id = 7 QUALIFY pool_pos <= 300), bad AS (SELECT embedding AS b FROM embeddings WHERE vec_id IN (3, 50, 120)), s AS (SELECT listing_id, pool_pos, listing_id IN (3, 50, 120) OR max({_dot('embedding', 'b')}) > 0.85 AS sunken FROM pool, bad GROUP BY 1, 2) SELECT listing_id, pool_pos, sunken, CAST(row_number() OVER (ORDER BY sunken, pool_pos) AS INT) AS place FROM s")
def _(spark, d):
    v = ds.vectors(spark, d)
    q = F.broadcast(v.where("listing_id = 7").select(F.col("embedding").alias("q")))
    scores = v.crossJoin(q).select("listing_id", (-dot(F.col("embedding"), F.col("q"))).alias("score"))
    pool = search.pool(v.select("listing_id"), scores, search.POOL)  # the best 300 of all
    return memory.demoted(pool, v, v.where("listing_id IN (3, 50, 120)").select("listing_id"), False)


_VISUAL = f"WITH own AS (SELECT vec_id // 5 AS listing_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, i), c AS (SELECT listing_id, list(m ORDER BY i) AS v FROM own GROUP BY 1), q AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) WHERE vec_id // 5 IN (2, 5, 9) GROUP BY i)) SELECT listing_id, round({_dot('v', 'q')} / sqrt({_dot('q', 'q')}) / sqrt({_dot('v', 'v')}), 9) AS score FROM c, q"


@query("mem_visual_taste", _VISUAL)
def _(spark, d):
    own = _images(spark, d)
    pool = own.select("listing_id").distinct()
    return memory.visual_taste(pool, own.select("listing_id", "embedding"), pool.where("listing_id IN (2, 5, 9)")).withColumn("score", F.round("score", 9))


@query("mem_feature_rank", f"{_TASTE_SQL}, mine AS (SELECT feature, taste FROM taste WHERE user_id = 5), s AS (SELECT listing_id, sum(taste * CASE WHEN (feature = 'feature_balcony' AND feature_balcony = 1) OR (feature = 'feature_elevator' AND feature_elevator = 1) OR (feature = 'feature_parking' AND feature_parking = 1) THEN 1 ELSE -1 END) AS v FROM listings, mine GROUP BY 1) SELECT listing_id, round(v, 9) AS score FROM s")
def _(spark, d):
    flags = ["feature_balcony", "feature_elevator", "feature_parking"]
    own = memory.feature_score(ds.listings(spark, d).select("listing_id", *flags), _taste(spark, d).where("user_id = 5"), flags)
    return own.withColumn("score", F.round("score", 9))


@query("default_feed", f"{_PRICE_SQL}, pool AS (SELECT *, row_number() OVER (ORDER BY listing_id) AS pos FROM (SELECT listing_id, price FROM listings ORDER BY listing_id LIMIT 400)), r AS (SELECT listing_id, row_number() OVER (ORDER BY -abs(ln(price) - mu) / greatest(sigma, 0.05) DESC, pos) AS r FROM pool, ps WHERE user_id = 5 AND price > 0) SELECT listing_id, round(coalesce(1.0 / (60 + r), 0), 9) AS rrf FROM pool LEFT JOIN r USING (listing_id) ORDER BY coalesce(1.0 / (60 + r), 0) DESC, pos LIMIT 20")
def _(spark, d):
    own = search.feed_pool(ds.listings(spark, d).select("listing_id", "price"), 20)
    stats = F.broadcast(_stats(spark, d).where("user_id = 5"))
    rank = ranking.rank_by(own.crossJoin(stats), "price", memory.price_score(F.col("price"), F.col("mu"), F.col("sigma")), True)
    out = own.join(ranking.rrf([rank]), "listing_id", "left").fillna({"rrf": 0.0}).orderBy(F.desc("rrf"), "pool_pos").limit(20)
    return out.select("listing_id", F.round("rrf", 9).alias("rrf"))


# --- explanations


@query("explain_hard_checks", f"{ds.L} SELECT listing_id, coalesce(city_slug IN ('brand#11', 'brand#23'), FALSE) AS city, coalesce(price BETWEEN 900 AND 1500, FALSE) AS price, coalesce(feature_balcony = 1, FALSE) AS balcony FROM listings")
def _(spark, d):
    checks = explain.hard_checks(FilterSpec(city=["brand#11", "brand#23"], min_price=900, max_price=1500, features=["balcony"]))
    own = ds.listings(spark, d).withColumn("checks", checks)
    at = lambda i, n: F.get("checks", F.lit(i))["passed"].alias(n)
    return own.select("listing_id", at(0, "city"), at(1, "price"), at(2, "balcony"))


@query("explain_soft_levels", f"{ds.S} SELECT listing_id, CASE WHEN stop_m IS NULL THEN 'unknown' WHEN stop_m <= 300 THEN 'good' WHEN stop_m <= 600 THEN 'ok' ELSE 'poor' END AS stop, CASE WHEN schools IS NULL THEN 'unknown' WHEN schools >= 3 THEN 'good' WHEN schools >= 1 THEN 'ok' ELSE 'poor' END AS schools, CASE WHEN price_delta_canton IS NULL THEN 'unknown' WHEN price_delta_canton <= -0.1 THEN 'good' WHEN price_delta_canton >= 0.1 THEN 'poor' ELSE 'ok' END AS price FROM signals")
def _(spark, d):
    return ds.signals(spark, d).select("listing_id", explain.level(F.col("stop_m"), *explain.LEVELS["stop_m"]).alias("stop"), explain.level(F.col("schools"), *explain.LEVELS["schools"]).alias("schools"), explain.price_level(F.col("price_delta_canton"), "cheap").alias("price"))


@query("explain_keyword_hits", "SELECT doc_id, CAST(contains(lower(text), 'with') AS INT) + CAST(contains(lower(text), 'für') AS INT) + CAST(contains(lower(text), 'the') AS INT) AS hits FROM documents")
def _(spark, d):
    hit, missed = explain.keyword_hits(["With", "für", "the"], ["text"])
    return ds.table(spark, d, "documents").select("doc_id", F.size(hit).alias("hits"))


@query("reason_text", f"{ds.S} SELECT listing_id, coalesce(nullif(concat_ws('; ', CASE WHEN stop_m IS NOT NULL THEN printf('semantic %.3f', stop_m) END, CASE WHEN schools > 0 THEN printf('%d soft preferences', schools) END), ''), 'matches all hard filters') AS reason FROM signals")
def _(spark, d):
    text = ranking.reason(F.lit(1e9), F.col("stop_m"), F.col("schools"), F.lit(None).cast("double"))
    return ds.signals(spark, d).select("listing_id", text.alias("reason"))


# --- texts

@query("txt_slug_fold")  # SQL has no compatibility decomposition; a test holds it against a plain version
def _(spark, d):
    return ds.table(spark, d, "documents").select("doc_id", tx.slug(F.col("text")).alias("folded"))


@query("txt_html_strip", "SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' '), '') AS plain FROM pages")
def _(spark, d):
    return ds.table(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("plain"))


_HITS = {k: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws) for k, ws in tx.LANGUAGE_WORDS.items()}


@query("txt_guess_lang", "WITH s AS (SELECT doc_id, " + ", ".join(f"{h} AS {k}" for k, h in _HITS.items()) + " FROM documents) SELECT doc_id, CASE WHEN greatest(de, fr, it, en) < 2 THEN 'unk' WHEN de = greatest(de, fr, it, en) THEN 'de' WHEN fr = greatest(de, fr, it, en) THEN 'fr' WHEN it = greatest(de, fr, it, en) THEN 'it' ELSE 'en' END AS lang FROM s")
def _(spark, d):
    return ds.table(spark, d, "documents").select("doc_id", tx.language(F.col("text")).alias("lang"))


@query("txt_split_number", "WITH s AS (SELECT p_partkey, concat(p_name, ' ', CAST(p_size AS STRING), CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END) AS a FROM part) SELECT p_partkey, lower(trim(regexp_extract(a, '^(.+?)\\s(\\d+[A-Za-z]*(?:\\s+\\d+[A-Za-z]*)?)$', 1))) AS street, regexp_extract(a, '^(.+?)\\s+(\\d+[A-Za-z]*(?:\\s+\\d+[A-Za-z]*)?)\\s*$', 2) AS house FROM s")
def _(spark, d):
    a = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "b").otherwise(""))
    return ds.table(spark, d, "part").select("p_partkey", tx.street(a).alias("street"), tx.house_number(a).alias("house"))


@query("txt_phone_email", "SELECT doc_id, nullif(lower(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')), '') AS email FROM documents")
def _(spark, d):
    return ds.table(spark, d, "documents").select("doc_id", tx.email(F.col("text")).alias("email"))


@query("txt_area", f"{ds.L}, t AS (SELECT listing_id, concat('Flat of ', CAST(area * 5 AS STRING), CASE WHEN listing_id % 2 = 0 THEN ' m2' ELSE 'qm' END, ' here') AS s FROM listings), x AS (SELECT listing_id, TRY_CAST(regexp_extract(s, '(^|\\D)(\\d{{2,4}})\\s?(?:m2|m²|qm)', 2) AS INT) AS a FROM t) SELECT listing_id, CASE WHEN a BETWEEN 10 AND 500 THEN a END AS area FROM x")
def _(spark, d):
    s = F.concat(F.lit("Flat of "), (F.col("area") * 5).cast("string"), F.when(F.col("listing_id") % 2 == 0, " m2").otherwise("qm"), F.lit(" here"))
    return ds.listings(spark, d).select("listing_id", tx.area(s).alias("area"))


@query("txt_regex_negation")
def _(spark, d):
    own = ds.table(spark, d, "documents").select("doc_id", "text", tx.language(F.col("text")).alias("lang"))
    hit = tx.mention(F.col("text"), {"en": [r"\bwith\w*"], "de": [r"\bund\b"], "fr": [r"\bdans\b"]}, F.col("lang"))
    return own.select("doc_id", hit.alias("hit")).select("doc_id", "hit.value", "hit.lang", "hit.negated")


_TEMPLATE = "concat_ws(' | ', title, city_slug, CASE WHEN rooms IS NOT NULL THEN concat(CAST(CAST(rooms * 10 AS INT) AS STRING), ' tenths of rooms') END)"


@query("txt_doc_template_hash", f"{ds.L} SELECT listing_id, substr(sha256({_TEMPLATE}), 1, 16) AS doc_hash FROM listings")
def _(spark, d):
    return ds.listings(spark, d).selectExpr("listing_id", f"substring(sha2({_TEMPLATE}, 256), 1, 16) AS doc_hash")


@query("txt_token_sort", "SELECT p_partkey, array_to_string(list_sort(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')), ' ') AS token_key FROM part")
def _(spark, d):
    return ds.table(spark, d, "part").select("p_partkey", tx.token_sort(F.col("p_name")).alias("token_key"))


# --- enrichment


@query("enrich_seed_state", f"{_STATE_SQL} SELECT listing_id, field, source, CAST(confidence AS DOUBLE) AS confidence FROM state")
def _(spark, d):
    return _state(spark, d).select("listing_id", "field", "source", "confidence")


_BAD = "field = 'year_built' AND TRY_CAST(filled AS INT) < 1955"


@query("enrich_drop_bad", f"{_STATE_SQL} SELECT listing_id, field, CASE WHEN {_BAD} THEN 'UNKNOWN' ELSE filled END AS filled, CASE WHEN {_BAD} THEN 'DROPPED_bad_data' ELSE source END AS source FROM state")
def _(spark, d):
    out = enrich.drop_bad(_state(spark, d), F.expr(_BAD), F.lit("too_old"))
    return out.select("listing_id", "field", "filled", "source")


@query("enrich_pass_overlay", f"{_STATE_SQL} SELECT listing_id, field, CASE WHEN field = 'object_category' AND source = 'UNKNOWN-pending' AND listing_id % 4 = 0 THEN 'apartment' ELSE filled END AS filled, CASE WHEN field = 'object_category' AND source = 'UNKNOWN-pending' AND listing_id % 4 = 0 THEN 'text' WHEN source = 'UNKNOWN-pending' THEN 'UNKNOWN' ELSE source END AS source FROM state")
def _(spark, d):
    proposals = ds.listings(spark, d).where("listing_id % 4 = 0").selectExpr("listing_id", "'object_category' AS field", "'apartment' AS value", "'text' AS by", "CAST(0.8 AS DOUBLE) AS sure", "'Wohnung' AS said")
    out = enrich.sentinel_fill(enrich.overlay(_state(spark, d), proposals))
    return out.select("listing_id", "field", "filled", "source")


@query("enrich_sentinel_fill", f"{_STATE_SQL} SELECT count(*) FILTER (WHERE filled IS NULL) AS null_filled, count(*) FILTER (WHERE source = 'UNKNOWN-pending' AND listing_id % 2 = 1) AS pending, count(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 1) AS bad_confidence, count(*) FILTER (WHERE source = 'UNKNOWN' AND filled <> 'UNKNOWN') AS unknown_with_value FROM state")
def _(spark, d):
    own = _state(spark, d)  # half of the rows are filled, so that what is left pending shows
    return enrich.violations(enrich.sentinel_fill(own.where("listing_id % 2 = 0")).unionByName(own.where("listing_id % 2 = 1")))


_ADS = ["Helle Wohnung mit Balkon und Lift", "Bright flat with a fireplace and a garage", "Studio ohne Balkon in der Stadt", "appartement avec ascenseur et parking", "rien"]
_AD_SQL = "SELECT p_partkey AS listing_id, [" + ", ".join(f"'{x}'" for x in _ADS) + "][p_partkey % 5 + 1] AS t FROM part"


@query("enrich_feature_extraction", f"WITH a AS ({_AD_SQL}) SELECT listing_id, 'feature_balcony' AS field, CASE WHEN t LIKE '%mit Balkon%' THEN '1' WHEN t LIKE '%ohne Balkon%' THEN '0' ELSE 'UNKNOWN' END AS filled, CASE WHEN t LIKE '%Balkon%' THEN 'text_regex_de' ELSE 'UNKNOWN' END AS source, CAST(CASE WHEN t LIKE '%mit Balkon%' THEN 0.8 WHEN t LIKE '%ohne Balkon%' THEN 0.48 ELSE 0 END AS DOUBLE) AS confidence FROM a UNION ALL SELECT listing_id, 'feature_elevator', CASE WHEN t LIKE '%Lift%' OR t LIKE '%ascenseur%' THEN '1' ELSE 'UNKNOWN' END, CASE WHEN t LIKE '%Lift%' THEN 'text_regex_de' WHEN t LIKE '%ascenseur%' THEN 'text_regex_fr' ELSE 'UNKNOWN' END, CAST(CASE WHEN t LIKE '%Lift%' OR t LIKE '%ascenseur%' THEN 0.85 ELSE 0 END AS DOUBLE) FROM a UNION ALL SELECT listing_id, 'feature_garage', CASE WHEN t LIKE '%garage%' THEN '1' ELSE 'UNKNOWN' END, CASE WHEN t LIKE '%garage%' THEN 'text_regex_en' ELSE 'UNKNOWN' END, CAST(CASE WHEN t LIKE '%garage%' THEN 0.8 ELSE 0 END AS DOUBLE) FROM a")
def _(spark, d):
    t = F.get(F.array(*map(F.lit, _ADS)), (F.col("p_partkey") % 5).cast("int"))
    own = ds.table(spark, d, "part").select(F.col("p_partkey").alias("listing_id"), F.lit(None).cast("string").alias("title"), t.alias("description"), *[F.lit(None).cast("string").alias(f"feature_{n}") for n in ("balcony", "elevator", "garage")])
    state = enrich.seed(own, ["feature_balcony", "feature_elevator", "feature_garage"])
    out = enrich.sentinel_fill(enrich.extracted(state, own, ["balcony", "elevator", "garage"]))
    return out.select("listing_id", "field", "filled", "source", F.col("confidence").cast("double").alias("confidence"))


@query("txt_canton_of_region", "SELECT n_nationkey, ['ZH', 'GR', 'SG', NULL][n_nationkey % 4 + 1] AS canton FROM nation")
def _(spark, d):
    region = F.get(F.array(F.lit(" Zurich"), F.lit("Grisons"), F.lit("Saint Gallen"), F.lit("Elsewhere")), F.col("n_nationkey") % 4)
    return ds.table(spark, d, "nation").select("n_nationkey", tx.canton(region).alias("canton"))


_LOGINS = "SELECT event_id AS id, user_id, user_id % 7 AS address, event_type <> 'error' AS ok, CAST(ts AS TIMESTAMP) AS created_at FROM events WHERE event_type IN ('error', 'signup')"


@query("ratelimit_login", f"WITH a AS ({_LOGINS}), r AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM a), x AS (SELECT id, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY user_id, run ORDER BY epoch_us(created_at) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS u, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY address ORDER BY epoch_us(created_at) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS i FROM r) SELECT id, u >= 2 OR i >= 12 AS blocked FROM x")
def _(spark, d):
    own = ds.table(spark, d, "events").where("event_type IN ('error', 'signup')")
    own = own.select(F.col("event_id").alias("id"), "user_id", (F.col("user_id") % 7).alias("address"), (F.col("event_type") != "error").alias("ok"), F.col("ts").cast("timestamp").alias("created_at"))
    return interactions.login_limited(own, 2, 12, 86_400)


@query("ratelimit_token_bucket")  # a test holds it against a plain bucket
def _(spark, d):
    return interactions.token_bucket(ds.events(spark, d), 3, 1 / 40_000)


@query("enrich_coverage_topn", f"{ds.L} SELECT listing_id, (price IS NOT NULL)::INT + (rooms IS NOT NULL)::INT + (object_category IS NOT NULL)::INT + (latitude IS NOT NULL)::INT + (year_built IS NOT NULL)::INT AS filled FROM listings ORDER BY filled DESC, listing_id LIMIT 40")
def _(spark, d):
    count = sum((F.col(c).isNotNull().cast("int") for c in ("rooms", "object_category", "latitude", "year_built")), F.col("price").isNotNull().cast("int"))
    return ds.listings(spark, d).select("listing_id", count.alias("filled")).orderBy(F.desc("filled"), "listing_id").limit(40)


@query("enrich_stale_hash", f"{ds.L} SELECT listing_id FROM listings WHERE listing_id % 3 <> 0 OR listing_id % 5 = 0")
def _(spark, d):
    docs = ds.listings(spark, d).selectExpr("listing_id", "sha2(title, 256) AS doc_hash")
    stored = docs.where("listing_id % 3 = 0").withColumn("doc_hash", F.when(F.col("listing_id") % 5 == 0, "old").otherwise(F.col("doc_hash")))
    return enrich.stale(docs, stored).select("listing_id")


# --- entities, diversification, sets, streams

_NAMES = "SELECT DISTINCT 'k' AS kind, replace(lower(p_name), ' ', '_') AS canonical FROM part UNION SELECT DISTINCT 'k', split_part(lower(p_name), ' ', 1) FROM part WHERE p_partkey % 20 = 0"


@query("entity_token_merge", f"WITH RECURSIVE n AS ({_NAMES}), e AS (SELECT a.canonical AS a, b.canonical AS b FROM n a, n b WHERE a.canonical <> b.canonical AND (contains('_' || b.canonical || '_', '_' || a.canonical || '_') OR contains('_' || a.canonical || '_', '_' || b.canonical || '_'))), r AS (SELECT canonical AS x, canonical AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS canonical, arg_min(y, lpad(CAST(length(y) AS STRING), 4, '0') || y) AS root FROM r GROUP BY x")
def _(spark, d):
    part = ds.table(spark, d, "part")
    names = part.select(F.lit("k").alias("kind"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("canonical")).union(part.where("p_partkey % 20 = 0").select(F.lit("k"), F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)))).distinct()
    return entities.merged(names).select("canonical", "root")


_FIT = "length(trim(name)) >= 4 AND regexp_matches(name, '[A-Z0-9]')"
_BEST = f"c AS (SELECT replace(lower(p_brand), '#', '_') AS canonical, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE p_type END AS name, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, {_FIT} AS fit, row_number() OVER (PARTITION BY canonical ORDER BY {_FIT} DESC, n DESC, length(name), name) AS rn FROM c), best AS (SELECT canonical, CASE WHEN fit THEN name ELSE 'none' END AS name, n FROM r WHERE rn = 1)"


def _mentions(spark, d):
    return ds.table(spark, d, "part").select(F.col("p_partkey").alias("listing_id"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("canonical"), F.when(F.col("p_partkey") % 3 == 0, "lake").otherwise("transit").alias("kind"), F.when(F.col("p_partkey") % 4 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("name"))


@query("entity_best_query", f"WITH {_BEST} SELECT canonical, name, n FROM best")
def _(spark, d):
    return entities.best_query(_mentions(spark, d))


@query("entity_lookup_text", f"WITH {_BEST}, k AS (SELECT replace(lower(p_brand), '#', '_') AS canonical, CAST(p_size % 4 AS VARCHAR) AS city, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT canonical, city FROM k QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY n DESC, city) = 1) SELECT canonical, CASE WHEN contains(lower(name), city) THEN name ELSE name || ', ' || city END AS lookup FROM best JOIN t USING (canonical)")
def _(spark, d):
    cities = ds.table(spark, d, "part").select(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("canonical"), (F.col("p_size") % 4).cast("string").alias("city"))
    return entities.lookup_text(entities.best_query(_mentions(spark, d)), cities)


_TOPS = "SELECT replace(lower(p_brand), '#', '_') AS canonical, CASE WHEN p_partkey % 3 = 0 THEN 'lake' ELSE 'transit' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE p_type END AS name, CAST(p_size AS VARCHAR) AS city, p_partkey FROM part"


@query("entity_described", f"WITH m AS ({_TOPS}), g AS (SELECT canonical, kind, count(DISTINCT p_partkey) AS listings FROM m GROUP BY 1, 2), n AS (SELECT canonical, kind, name, count(*) AS c FROM m GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY canonical, kind ORDER BY c DESC, name) <= 10), k AS (SELECT canonical, kind, city, count(*) AS c FROM m GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY canonical, kind ORDER BY c DESC, city) <= 5) SELECT canonical, kind, listings, (SELECT string_agg(name, '|' ORDER BY c DESC, name) FROM n WHERE n.canonical = g.canonical AND n.kind = g.kind) AS names, (SELECT string_agg(city, '|' ORDER BY c DESC, city) FROM k WHERE k.canonical = g.canonical AND k.kind = g.kind) AS cities FROM g")
def _(spark, d):
    cities = ds.table(spark, d, "part").select(F.col("p_partkey").alias("listing_id"), F.col("p_size").cast("string").alias("city"))
    out = entities.described(_mentions(spark, d), cities)
    return out.select("canonical", "kind", "listings", F.array_join("names", "|").alias("names"), F.array_join("cities", "|").alias("cities"))


@query("pareto_frontier", f"{ds.L}, x AS (SELECT listing_id, coalesce(price, CAST('infinity' AS DOUBLE)) AS a, coalesce(-CAST(area AS DOUBLE), CAST('infinity' AS DOUBLE)) AS b FROM listings) SELECT listing_id FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))")
def _(spark, d):
    return diversify.pareto(ds.listings(spark, d).select("listing_id", "price", "area"), "listing_id", ["price"], ["area"]).select("listing_id")


_MMR = f"""WITH RECURSIVE {ds.L.removeprefix('WITH ')},
pool AS (SELECT listing_id AS k, 1 - price / 3000 AS rel, city_slug AS c, round_even(price / 500, 0) AS b, row_number() OVER (ORDER BY 1 - price / 3000 DESC, listing_id) AS pos FROM listings WHERE price IS NOT NULL ORDER BY pos LIMIT 30),
far AS (SELECT x.k AS k, y.k AS o, (CAST(x.c <> y.c AS INT) + CAST(x.b <> y.b AS INT)) / 2.0 AS d FROM pool x, pool y),
step AS (SELECT 1 AS place, [k] AS picked FROM pool WHERE pos = 1
  UNION ALL
  SELECT place + 1, list_append(any_value(picked), arg_max(k, score - pos * 1e-9)) FROM (
    SELECT s.place, s.picked, p.k, p.pos, round(0.7 * any_value(p.rel) + 0.3 * min(f.d), 12) AS score FROM step s, pool p, far f
    WHERE s.place < 20 AND NOT list_contains(s.picked, p.k) AND f.k = p.k AND list_contains(s.picked, f.o) GROUP BY s.place, s.picked, p.k, p.pos) GROUP BY place)
SELECT picked[i] AS listing_id, CAST(i AS INT) AS place FROM (SELECT picked FROM step WHERE place = 20), range(1, 21) r(i)"""


@query("mmr_topk", _MMR)
def _(spark, d):
    own = ds.listings(spark, d).where("price IS NOT NULL").select("listing_id", (1 - F.col("price") / 3000).alias("relevance"), "city_slug", "price")
    pool = own.orderBy(F.desc("relevance"), "listing_id").limit(30)
    return diversify.mmr(pool, "listing_id", "relevance", {"city_slug": None, "price": 500.0}, 20)


@query("set_union_distinct", "SELECT o_custkey FROM orders WHERE o_totalprice > 150000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _(spark, d):
    return ds.table(spark, d, "orders").where("o_totalprice > 150000").select("o_custkey").union(ds.table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey")).distinct()


@query("set_union_all", "SELECT o_custkey AS k, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def _(spark, d):
    return ds.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("kind")).unionByName(ds.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind")))


@query("set_intersect", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(spark, d):
    return ds.table(spark, d, "customer").select("c_custkey").intersect(ds.table(spark, d, "orders").select("o_custkey"))


@query("set_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return ds.table(spark, d, "customer").select("c_custkey").subtract(ds.table(spark, d, "orders").select("o_custkey"))


@query("ratelimit_sliding_window", f"{ds.E}, r AS (SELECT id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(created_at) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS tries FROM ev) SELECT id, user_id, tries, tries > 2 AS blocked FROM r")
def _(spark, d):
    return interactions.rate_limited(ds.events(spark, d), 2, 7200)


@query("session_gap", f"{ds.E}, g AS (SELECT user_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM ev), s AS (SELECT user_id, created_at, sum(b) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS g FROM g) SELECT user_id, epoch_us(min(created_at)) AS start_us, count(*) AS n FROM s GROUP BY user_id, g")
def _(spark, d):
    out = interactions.sessions(ds.events(spark, d), "6 hours")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


_AGED = f"""WITH RECURSIVE {ds.E.removeprefix('WITH ')}, g AS (SELECT user_id, created_at, coalesce(created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id) >= INTERVAL 2 DAYS, TRUE) AS apart FROM ev),
s AS (SELECT user_id, min(created_at) AS b FROM g GROUP BY 1 UNION ALL SELECT s.user_id, min(g.created_at) FROM s JOIN g ON g.user_id = s.user_id AND g.created_at > s.b AND (g.apart OR g.created_at >= s.b + INTERVAL 7 DAYS) GROUP BY s.user_id, s.b)
SELECT s.user_id, epoch_us(s.b) AS start_us, epoch_us(least(max(g.created_at) + INTERVAL 2 DAYS, s.b + INTERVAL 7 DAYS)) AS end_us, count(*) AS n FROM s JOIN g ON g.user_id = s.user_id AND g.created_at >= s.b AND NOT EXISTS (SELECT 1 FROM s t WHERE t.user_id = s.user_id AND t.b > s.b AND t.b <= g.created_at) GROUP BY s.user_id, s.b"""


@query("session_absolute_age", _AGED)
def _(spark, d):
    out = interactions.sessions(ds.events(spark, d), "2 days", 7)
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("history_window", f"{ds.E} SELECT user_id, count(*) AS n FROM ev WHERE created_at >= TIMESTAMP '2024-01-21' AND created_at <= TIMESTAMP '2024-01-31' GROUP BY 1")
def _(spark, d):
    return memory.recent(ds.events(spark, d), ds.AS_OF, 10).groupBy("user_id").agg(F.count("*").alias("n"))


@query("stream_tumbling_batch_form", f"{ds.E} SELECT epoch_us(time_bucket(INTERVAL 1 DAY, created_at)) AS start_us, kind, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, d):
    return interactions.windowed(ds.events(spark, d), "1 day").select(F.unix_micros("start").alias("start_us"), "kind", "n")


# --- more of images, enrichment and search

_BATCH = f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id // 5 AS listing_id, e.vec_id AS image_id, {_dot('e.embedding', 'q.embedding')} AS s FROM embeddings e, embeddings q WHERE q.vec_id IN (2, 9, 33)), b AS (SELECT query_id, listing_id, max(s) AS score, arg_max(image_id, s) AS image_id FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, listing_id) AS rn FROM b)"


def _images(spark, d):
    return ds.table(spark, d, "embeddings").select(F.expr("vec_id DIV 5").alias("listing_id"), F.col("vec_id").alias("image_id"), "embedding", "label")


@query("image_batch_search", f"{_BATCH} SELECT query_id, listing_id, image_id, round(score, 9) AS score, CAST(rn AS INT) AS place FROM r WHERE rn <= 8")
def _(spark, d):
    q = ds.table(spark, d, "embeddings").where("vec_id IN (2, 9, 33)").select(F.col("vec_id").alias("query_id"), "embedding")
    return images.batch_search(_images(spark, d), q, 8).withColumn("score", F.round("score", 9))


@query("image_search_hydrated", f"{_BATCH} SELECT listing_id * 10 AS listing_id, round(score, 9) AS score FROM r WHERE query_id = 9 AND listing_id % 2 = 0")
def _(spark, d):
    own = _images(spark, d)
    found = search.best_per_listing(own, own.where("image_id = 9")).select(F.col("listing_id").alias("platform_id"), F.round("score", 9).alias("score"))
    ids = own.where("listing_id % 2 = 0").select(F.col("listing_id").alias("platform_id"), (F.col("listing_id") * 10).alias("listing_id")).distinct()
    return images.hydrated(found, ids).select("listing_id", "score")


@query("image_store_report", "SELECT CASE WHEN vec_id % 4 = 0 THEN 'floorplan' ELSE 'main' END AS index_kind, label, count(*) AS n, (vec_id % 4 = 0 AND label < 3) OR (vec_id % 4 <> 0 AND label < 9) AS allowed FROM embeddings GROUP BY ALL")
def _(spark, d):
    own = ds.table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 4 == 0, "floorplan").otherwise("main").alias("index_kind"), "label")
    return images.store_report(own, {"floorplan": ["0", "1", "2"], "main": [str(i) for i in range(9)]})


@query("image_self_match", f"SELECT image_id, vec_id = image_id AS ok FROM (SELECT q.vec_id AS image_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_dot('e.embedding', 'q.embedding')} DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE r = 1")
def _(spark, d):
    own = _images(spark, d)
    return images.self_match(own, own.where("image_id % 50 = 0"))


@query("image_orphans", "SELECT vec_id AS image_id FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part)")
def _(spark, d):
    return images.orphans(_images(spark, d), ds.table(spark, d, "part").select(F.col("p_partkey").alias("image_id")))


@query("crosscheck_hits", f"{ds.L} SELECT v.vec_id AS listing_id, l.listing_id IS NOT NULL AS known, coalesce(price < 1500, FALSE) AS cheap FROM embeddings v LEFT JOIN listings l ON l.listing_id = v.vec_id")
def _(spark, d):
    hits = ds.table(spark, d, "embeddings").select(F.col("vec_id").alias("listing_id"))
    return images.crosscheck(hits, ds.listings(spark, d), {"cheap": F.col("price") < 1500})


@query("enrich_geocode_nearest", f"{ds.G}, r AS (SELECT id, target_id, {ds.km('lat', 'lon', 'tlat', 'tlon')} AS k FROM points, landmarks), n AS (SELECT id, min_by(target_id, k) AS t FROM r GROUP BY id) SELECT id AS listing_id, 'city' AS field, landmark AS value FROM n JOIN landmarks ON t = target_id UNION ALL SELECT id, 'canton', 'K' || CAST(target_id AS STRING) FROM n JOIN landmarks ON t = target_id")
def _(spark, d):
    towns = ds.landmarks(spark, d).select("target_id", "tlat", "tlon", F.col("landmark").alias("city"), F.concat(F.lit("K"), F.col("target_id").cast("string")).alias("canton"))
    return enrich.geocoded(ds.points(spark, d), towns, 40.0).select("listing_id", "field", "value")


@query("enrich_majority_fill", "WITH c AS (SELECT c_nationkey AS plz, c_mktsegment AS canton, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY ALL), v AS (SELECT plz, canton, row_number() OVER (PARTITION BY plz ORDER BY n DESC, canton) AS rn FROM c) SELECT c_custkey AS listing_id, v.canton AS value FROM customer JOIN v ON plz = c_nationkey WHERE c_custkey % 3 = 0 AND rn = 1")
def _(spark, d):
    own = ds.table(spark, d, "customer").select(F.col("c_custkey").alias("listing_id"), F.col("c_nationkey").alias("plz"), F.col("c_mktsegment").alias("canton"))
    return enrich.voted(own.where("listing_id % 3 = 0").select("listing_id", "plz"), own.where("listing_id % 3 <> 0"), "plz", "canton").select("listing_id", "value")


@query("enrich_new_fields_pending", f"{_STATE_SQL} SELECT listing_id, field, source FROM state UNION ALL SELECT listing_id, f, 'UNKNOWN-pending' FROM listings, (SELECT unnest(['cellar', 'kitchen']) AS f)")
def _(spark, d):
    return enrich.with_fields(_state(spark, d), ds.listings(spark, d), ["cellar", "kitchen", "price"]).select("listing_id", "field", "source")


@query("structured_search_page", f"{ds.L} SELECT listing_id, CAST(0 AS DOUBLE) AS result_score FROM listings WHERE rooms >= 5 ORDER BY price NULLS LAST, listing_id LIMIT 15 OFFSET 5")
def _(spark, d):
    spec = FilterSpec(min_rooms=5, sort_by="price_asc", limit=15, offset=5)
    return search.structured(gate(ds.listings(spark, d), spec), spec).select("listing_id", F.col("result_score").cast("double").alias("result_score"))


@query("commute_rows_kept", f"{ds.G}, r AS (SELECT id, target_id, {ds.km('lat', 'lon', 'tlat', 'tlon')} AS k, CASE WHEN id % 3 > 0 THEN id % 50 END AS t FROM points, landmarks) SELECT id, target_id FROM r WHERE k <= 40 AND NOT (t IS NULL AND k > 20)")
def _(spark, d):
    rows = sg.distances(ds.points(spark, d), ds.landmarks(spark, d), 40.0).withColumn("travel_min", F.when(F.col("id") % 3 > 0, F.col("id") % 50))
    return sg.commute_rows(rows).select("id", "target_id")


@query("landmark_aliases", "SELECT n_name AS name, n_nationkey AS k FROM nation")
def _(spark, d):
    n = ds.table(spark, d, "nation")
    gazetteer = n.select(F.concat(F.lit("key_"), F.col("n_nationkey").cast("string")).alias("key"), F.array(F.initcap("n_name")).alias("aliases"))
    found = resolve_landmarks(n.select(F.col("n_name").alias("name")), gazetteer)
    return found.select("name", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("k"))


@query("txt_html_parsed")  # SQL decodes no entities; a test holds it against the standard library's parser
def _(spark, d):
    return ds.table(spark, d, "pages").select("page_id", tx.html_parsed(F.col("html")).alias("plain"))


@query("project_api_row", f"{ds.L} SELECT listing_id, CAST(round_even(price, 0) AS INT) AS price, CAST(round_even(area / 7.0, 0) AS INT) AS area, feature_balcony = 1 AS balcony FROM listings")
def _(spark, d):
    return ds.listings(spark, d).select("listing_id", F.bround("price", 0).cast("int").alias("price"), F.bround(F.col("area") / 7, 0).cast("int").alias("area"), (F.col("feature_balcony") == 1).alias("balcony"))


@query("txt_tri_state_merge", f"{ds.L} SELECT listing_id, CASE WHEN feature_balcony = 1 OR feature_elevator = 1 OR feature_parking = 1 THEN 1 WHEN feature_balcony = 0 OR feature_elevator = 0 OR feature_parking = 0 THEN 0 END AS any_feature FROM listings")
def _(spark, d):
    return ds.listings(spark, d).select("listing_id", tx.tri_state(F.col("feature_balcony"), F.col("feature_elevator"), F.col("feature_parking")).alias("any_feature"))


@query("vec_softmax", "WITH l AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings), e AS (SELECT vec_id, list_transform(a, lambda x: exp((x - list_max(a)) * 10)) AS p FROM l) SELECT vec_id, round(list_max(list_transform(p, lambda x: x / list_sum(p))), 9) AS top FROM e")
def _(spark, d):
    a = F.transform("embedding", lambda x: x.cast("double"))
    return ds.table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(softmax(a, 10.0)), 9).alias("top"))
