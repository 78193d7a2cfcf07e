"""Derived signals: price baselines, spatial joins, hardening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodefuse.functions.geo import DEGREE_KM, cell, haversine_km, neighbours
from lodefuse.sources.shared import stored

MIN_BUCKET = 5
#: Rows of a gazetteer that may be broadcast.
BROADCAST_ROWS = 20_000
# fixed values: votes that count as many, and as few
MANY_VOTES, FEW_VOTES = 5, 3


def rooms_bucket(rooms: Column) -> Column:
    """Rooms to the next half, half up; only from above 0 to 15."""
    half = F.floor(rooms * 2 + 0.5) / 2
    return F.when((half > 0) & (half <= 15), half)


def price_baselines(df: DataFrame, keys: list[str], price: str = "price", least: int = MIN_BUCKET, digits: int = 2) -> DataFrame:
    """Exact median price and size of each bucket that has enough rows and whole keys."""
    valid = df.where(f"{price} > 0").where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return valid.groupBy(*keys).agg(F.round(F.median(price), digits).alias("baseline"), F.count("*").alias("n")).where(F.col("n") >= least)


def price_delta(df: DataFrame, baselines: DataFrame, keys: list[str], name: str, price: str = "price") -> DataFrame:
    """df with the ratio by which a price lies above its bucket's baseline."""
    found = df.join(baselines.select(*keys, "baseline"), keys, "left")
    return found.withColumn(name, F.round((F.col(price) - F.col("baseline")) / F.col("baseline"), 4)).drop("baseline")


def plausibility(delta: Column) -> Column:
    return F.when(delta.isNull(), None).when(F.abs(delta) > 3, "suspect").otherwise("normal")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def commute_proxy(stop_m: Column, hub_m: Column) -> Column:
    """Minutes to walk to the stop and ride to the hub; null if either is unknown."""
    return stop_m / 80 + hub_m / 1000


def _cells(df: DataFrame, size: float, spread: bool, lat: str, lon: str) -> DataFrame:
    x, y = cell(F.col(lat), size), cell(F.col(lon), size)
    if not spread:
        return df.withColumns({"gx": x, "gy": y})
    return df.withColumn("gx", F.explode(neighbours(x))).withColumn("gy", F.explode(neighbours(y)))


def within(points: DataFrame, targets: DataFrame, radius_km: float, max_lat: float = 60.0, tasks: int | None = None) -> DataFrame:
    """Pairs of points (id, lat, lon) and targets (target_id, tlat, tlon) within a radius, met on a grid.

    A cell is at least the radius high, and wide, up to max_lat degrees from the equator. With `tasks`
    cells are dealt to so many: few bytes can make many pairs, and Spark would merge small tasks.
    """
    import math

    size = radius_km / DEGREE_KM / max(0.05, math.cos(math.radians(max_lat)))
    own, others = _cells(points, size, False, "lat", "lon"), _cells(targets, size, True, "tlat", "tlon")
    if tasks:
        own, others = own.repartition(tasks, "gx", "gy"), others.repartition(tasks, "gx", "gy")
    met = own.join(others, ["gx", "gy"])
    out = met.withColumn("dist_km", haversine_km(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon")))
    return out.where(F.col("dist_km") <= radius_km).drop("gx", "gy")


def radius_count(points: DataFrame, targets: DataFrame, radius_km: float) -> DataFrame:
    """(id, n): how many targets each point has within the radius; none is 0.

    Places meet once, however many points or targets share them.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spots, there = points.select("lat", "lon").distinct(), targets.groupBy("tlat", "tlon").agg(F.count("*").alias("w"))
    found = within(spots, there, radius_km, tasks=tasks).groupBy("lat", "lon").agg(F.sum("w").alias("n"))
    own = points.select("id", "lat", "lon").join(found, ["lat", "lon"], "left")
    return own.groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _typical_km(targets: DataFrame) -> float:
    """A radius within which evenly spread targets would leave few points without one."""
    import math

    box = targets.agg(F.count("*").alias("n"), (F.max("tlat") - F.min("tlat")).alias("h"), (F.max("tlon") - F.min("tlon")).alias("w")).first()
    if not box["n"]:
        return 20_200.0
    return min(5_000.0, max(1.0, 2 * DEGREE_KM * math.sqrt(max(box["h"] or 0.0, 0.01) * max(box["w"] or 0.0, 0.01) / box["n"])))


def nearest(points: DataFrame, targets: DataFrame, first_km: float | None = None, rounds: int = 12) -> DataFrame:
    """(id, target_id, dist_km): the nearest target, the least id of equals; rings widen until every point has one.

    The first ring is as wide as the targets' density suggests, unless given.
    """
    left, out = points.where("lat IS NOT NULL AND lon IS NOT NULL"), []
    radius = first_km or _typical_km(targets)
    for _ in range(rounds):
        found = within(left, targets, radius).groupBy("id").agg(F.min(F.struct("dist_km", "target_id")).alias("m")).select("id", "m.target_id", "m.dist_km")
        found = stored(found, "ring")  # the next ring and the result read it
        out.append(found)
        if radius > 20_100:
            break
        left = left.join(found, "id", "left_anti")
        if left.limit(1).count() == 0:
            break
        radius *= 4
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def distances(points: DataFrame, landmarks: DataFrame, cutoff_km: float | None = None) -> DataFrame:
    """Every point with every landmark, within the cutoff.

    With a cutoff they meet on a grid; without one, or with one of continents, the gazetteer
    is sent to the points and must not have more than BROADCAST_ROWS.
    """
    if cutoff_km is not None and cutoff_km < 1000:
        return within(points.where("lat IS NOT NULL AND lon IS NOT NULL"), landmarks, cutoff_km)
    if landmarks.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"every point with every one of over {BROADCAST_ROWS} landmarks: give a cutoff")
    out = points.crossJoin(F.broadcast(landmarks)).withColumn("dist_km", haversine_km(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon")))
    return out.where(F.col("dist_km") <= cutoff_km) if cutoff_km is not None else out


def segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to a short segment, in the plane around the point."""
    scale = F.cos(F.radians(lat))
    px, py = (lon - lon1) * scale, lat - lat1
    dx, dy = (lon2 - lon1) * scale, lat2 - lat1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / length))).otherwise(0.0)
    return F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2)) * DEGREE_KM


def nearest_line(points: DataFrame, segments: DataFrame, cap_km: float = 5.0) -> DataFrame:
    """(id, dist_km): to the nearest segment (lat1, lon1, lat2, lon2), null beyond the cap; segments go to the cells they may be near."""
    size = 2 * cap_km / DEGREE_KM
    lo = lambda a, b: F.floor((F.least(a, b) - size) / size)
    hi = lambda a, b: F.floor((F.greatest(a, b) + size) / size)
    spread = segments.withColumn("gx", F.explode(F.sequence(lo("lat1", "lat2"), hi("lat1", "lat2")))).withColumn("gy", F.explode(F.sequence(lo("lon1", "lon2"), hi("lon1", "lon2"))))
    met = _cells(points, size, False, "lat", "lon").join(spread, ["gx", "gy"])
    near = met.withColumn("d", segment_km(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")])).where(F.col("d") <= cap_km).groupBy("id").agg(F.min("d").alias("dist_km"))
    return points.select("id").join(near, "id", "left")


def nearest_k(points: DataFrame, landmarks: DataFrame, k: int = 5, cutoff_km: float | None = None) -> DataFrame:
    """The k nearest landmarks of each point with their place."""
    by = Window.partitionBy("id").orderBy("dist_km", "target_id")
    return distances(points, landmarks, cutoff_km).withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, confidence): the most frequent value, the least of equals, and how sure the vote is."""
    counts = df.where(f"{key} IS NOT NULL AND {value} IS NOT NULL").groupBy(key, value).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(key)
    top = counts.withColumn("total", F.sum("n").over(whole)).withColumn("rn", F.row_number().over(whole.orderBy(F.desc("n"), F.asc(value)))).where("rn = 1")
    share = F.col("n") / F.col("total")
    return top.select(key, value, "n", "total", vote_confidence(share, F.col("total")).alias("confidence"))


def vote_confidence(share: Column, total: Column) -> Column:
    """How sure a vote is: near agreement counts by how many voted, a mere majority little."""
    many, few = total >= MANY_VOTES, total <= FEW_VOTES
    return F.when((share >= 1) & many, 0.85).when((share >= 0.95) & many, 0.75).when((share >= 0.95) & few, 0.65).when(share >= 0.75, 0.60).otherwise(0.45)


def stop_profiles(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """(stop_id, lines, mode): distinct routes and the most frequent route type of each station (child stops count for their parent)."""
    station = stops.select("stop_id", F.coalesce(F.nullif("parent_station", F.lit("")), "stop_id").alias("station"))
    met = stop_times.select("stop_id", "trip_id").join(trips.select("trip_id", "route_id"), "trip_id").join(routes.select("route_id", "route_type"), "route_id").join(station, "stop_id")
    lines = met.groupBy("station").agg(F.count_distinct("route_id").alias("lines"))
    modes = met.groupBy("station", "route_type").agg(F.count("*").alias("n")).groupBy("station").agg(F.max_by("route_type", F.struct("n", "route_type")).alias("mode"))
    return lines.join(modes, "station").select(F.col("station").alias("stop_id"), "lines", "mode")


def commute_rows(df: DataFrame) -> DataFrame:
    """Rows worth keeping: none beyond 40 km, none without a time beyond 20 km."""
    return df.where("dist_km <= 40 AND NOT (travel_min IS NULL AND dist_km > 20)")
