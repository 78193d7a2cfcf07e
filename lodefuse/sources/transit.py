"""Timetable feeds (GTFS) as text tables, cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: primary keys and columns of the feed's files
KEYS = {"stops": ["stop_id"], "routes": ["route_id"], "trips": ["trip_id"]}
COLUMNS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string",
    "routes": "route_id string, route_type int",
    "trips": "trip_id string, route_id string",
    "stop_times": "trip_id string, stop_id string",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file of the feed, by column name; columns it lacks are null."""
    raw = spark.read.option("header", True).csv(f"{folder}/{name}.txt")
    fields = [f.split(" ") for f in COLUMNS[name].split(", ")]
    out = raw.select(*[(F.trim(F.col(n)).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])
    return first_of(out, KEYS[name]) if name in KEYS else out


def first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row in file order of each key."""
    by = Window.partitionBy(*keys).orderBy("file_order")
    ordered = df.withColumn("file_order", F.monotonically_increasing_id()).withColumn("rn", F.row_number().over(by))
    return ordered.where("rn = 1").drop("rn", "file_order")
