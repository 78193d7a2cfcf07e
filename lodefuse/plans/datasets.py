"""The driver's tables as listings, points, interactions and vectors: projections that Spark and the checking SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAT = "CAST(({k} * 7919) % 2100 AS DOUBLE) / 1000 + CAST(45.8 AS DOUBLE)"
LON = "CAST(({k} * 104729) % 4600 AS DOUBLE) / 1000 + CAST(5.9 AS DOUBLE)"


def _null(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN NULL ELSE {value} END"


LISTINGS = [
    "p_partkey AS listing_id",
    "p_name AS title",
    "lower(p_brand) AS city_slug",
    "concat('C', CAST(p_partkey % 5 AS STRING)) AS canton",
    "CAST(1000 + p_partkey % 50 AS INT) AS postal_code",
    "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'apartment' WHEN 2 THEN 'villa' WHEN 3 THEN 'studio' WHEN 4 THEN 'house' ELSE 'loft' END AS object_category",
    f"{_null('p_partkey % 7 = 0', 'p_retailprice')} AS price",
    f"{_null('p_partkey % 13 = 0', 'CAST(p_size AS DOUBLE) / 2')} AS rooms",
    "CAST(p_partkey % 150 + 20 AS INT) AS area",
    "CAST(p_partkey % 9 - 1 AS INT) AS floor",
    f"{_null('p_partkey % 5 = 0', 'CAST(1950 + p_partkey % 75 AS INT)')} AS year_built",
    f"{_null('p_partkey % 9 = 0', "concat('2024-', lpad(CAST(p_partkey % 12 + 1 AS STRING), 2, '0'), '-15')")} AS available_from",
    f"{_null('p_partkey % 11 = 0', LAT.format(k='p_partkey'))} AS latitude",
    f"{_null('p_partkey % 11 = 0', LON.format(k='p_partkey'))} AS longitude",
    "CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS feature_balcony",
    "CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS feature_elevator",
    "CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS feature_parking",
    "CASE p_partkey % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN '2.5' WHEN 2 THEN '1' ELSE '3' END AS bathrooms",
    "CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'UNKNOWN' END AS has_cellar",
]

SIGNALS = [
    "c_custkey AS listing_id",
    "c_custkey AS pool_pos",
    f"{_null('c_custkey % 6 = 0', '(c_acctbal - 4500) / 4500')} AS price_delta_canton",
    f"{_null('c_custkey % 5 = 0', '(c_acctbal - 4000) / 4000')} AS price_delta_plz",
    "CASE WHEN c_custkey % 8 = 0 THEN 'suspect' WHEN c_custkey % 9 = 0 THEN NULL ELSE 'normal' END AS plausibility",
    f"{_null('c_custkey % 7 = 0', 'CAST((c_custkey * 37) % 1500 AS DOUBLE)')} AS stop_m",
    f"{_null('c_custkey % 10 = 0', 'CAST((c_custkey * 13) % 150 AS INT)')} AS lines",
    f"{_null('c_custkey % 4 = 0', 'CAST((c_custkey * 11) % 2000 AS DOUBLE)')} AS motorway_m",
    f"{_null('c_custkey % 3 = 0', 'CAST((c_custkey * 17) % 900 AS DOUBLE)')} AS primary_m",
    f"{_null('c_custkey % 12 = 0', 'CAST(c_custkey % 6 AS INT)')} AS schools",
    f"{_null('c_custkey % 5 = 1', 'CAST((c_custkey * 7) % 90 AS DOUBLE)')} AS commute_proxy_min",
]

POINTS = ["c_custkey AS id", f"{LAT.format(k='c_custkey')} AS lat", f"{LON.format(k='c_custkey')} AS lon", "c_nationkey AS region"]
STOPS = ["s_suppkey AS target_id", f"{LAT.format(k='(s_suppkey + 31)')} AS tlat", f"{LON.format(k='(s_suppkey + 31)')} AS tlon"]
LANDMARKS = ["CAST(n_nationkey AS BIGINT) AS target_id", f"{LAT.format(k='(n_nationkey + 57)')} AS tlat", f"{LON.format(k='(n_nationkey + 57)')} AS tlon", "n_name AS landmark"]

_KIND = "CASE event_type WHEN 'purchase' THEN 'bookmark' WHEN 'signup' THEN 'like' WHEN 'click' THEN 'click' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'undismiss' ELSE 'dismiss' END ELSE 'dwell' END AS kind"
_EVENT = ["event_id AS id", "user_id", "{item} AS listing_id", _KIND, "value", "CAST(ts AS TIMESTAMP) AS created_at"]
EVENTS = [x.format(item="CAST(get_json_object(props, '$.k') AS BIGINT)") for x in _EVENT]
EVENTS_SQL = [x.format(item="CAST(json_extract_string(props, '$.k') AS BIGINT)") for x in _EVENT]

AS_OF = "2024-01-31"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def project(spark: SparkSession, d: str, name: str, columns: list[str]) -> DataFrame:
    return table(spark, d, name).selectExpr(*columns)


def listings(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "part", LISTINGS)


def signals(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "customer", SIGNALS)


def points(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "customer", POINTS)


def stops(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "supplier", STOPS)


def landmarks(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "nation", LANDMARKS)


def events(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "events", EVENTS)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("listing_id"), "embedding", "label")


def sql_with(**parts: tuple[list[str], str]) -> str:
    """WITH clause of projections: name=(columns, table)."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(c)} FROM {t})" for n, (c, t) in parts.items())


L = sql_with(listings=(LISTINGS, "part"))
S = sql_with(signals=(SIGNALS, "customer"))
E = sql_with(ev=(EVENTS_SQL, "events"))
G = sql_with(points=(POINTS, "customer"), stops=(STOPS, "supplier"), landmarks=(LANDMARKS, "nation"))
LE = sql_with(listings=(LISTINGS, "part"), ev=(EVENTS_SQL, "events"))


def km(a: str, b: str, c: str, d: str) -> str:
    """The haversine distance in the checking SQL."""
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h}))))"
