"""Rankings, their fusion, soft preferences, scores and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rank_by(df: DataFrame, name: str, value: Column, descending: bool = False, pool: str = "pool_pos", drop: Column | None = None) -> DataFrame:
    """(ranking, listing_id, rank) by a value; rows without one are left out, ties keep the pool's order."""
    own = df.withColumn("value", value).where("value IS NOT NULL")
    if drop is not None:
        own = own.where(~F.coalesce(drop, F.lit(False)))
    by = Window.orderBy(F.desc("value") if descending else F.asc("value"), F.asc(pool))  # a pool is a page's candidates
    return own.select(F.lit(name).alias("ranking"), "listing_id", F.row_number().over(by).alias("rank"))


def rrf(rankings: list[DataFrame], k: int = K) -> DataFrame:
    """(listing_id, rrf): reciprocal rank fusion; an item's first place in a ranking counts."""
    every = reduce(DataFrame.unionByName, rankings)
    first = every.groupBy("ranking", "listing_id").agg(F.min("rank").alias("rank"))
    return first.groupBy("listing_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))


def price_value() -> Column:
    return F.coalesce("price_delta_canton", "price_delta_plz")


def quiet_value() -> Column:
    """Metres to motorway and main road, summed over those known."""
    parts = [F.col("motorway_m"), F.col("primary_m")]
    return F.when(parts[0].isNotNull() | parts[1].isNotNull(), F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)))


def transit_value() -> Column:
    """Near stops with many lines; null only if neither is known."""
    near = -F.col("stop_m") / 1000
    lines = F.log1p(F.least(F.greatest(F.col("lines"), F.lit(0)), F.lit(100)).cast("double"))
    return F.when(F.col("stop_m").isNotNull() | F.col("lines").isNotNull(), F.coalesce(near, F.lit(0.0)) + F.coalesce(lines, F.lit(0.0)))


def soft_rankings(pool: DataFrame, price: str | None = None, quiet: bool = False, transit: bool = False, commute: str | None = None, counts: tuple[str, ...] = (), landmarks: tuple[str, ...] = (), travel: DataFrame | None = None) -> list[DataFrame]:
    """A ranking for each activated preference. travel: (listing_id, landmark_key, travel_min, dist_m)."""
    out = []
    if price in ("cheap", "premium"):  # 'moderate' activates nothing
        out.append(rank_by(pool, "price", price_value(), price == "premium", drop=F.col("plausibility") == "suspect"))
    if quiet:
        out.append(rank_by(pool, "quiet", quiet_value(), True))
    if transit:
        out.append(rank_by(pool, "transit", transit_value(), True))
    for name in counts:
        out.append(rank_by(pool, name, F.col(name), True))
    if commute:
        real = travel.where(F.col("landmark_key") == commute).select("listing_id", F.col("travel_min").alias("real_min"))
        out.append(rank_by(pool.join(real, "listing_id", "left"), "commute", F.coalesce("real_min", "commute_proxy_min")))
    for key in landmarks:
        own = travel.where(F.col("landmark_key") == key).select("listing_id", F.coalesce(F.col("travel_min").cast("double"), F.col("dist_m") / 80).alias("near"))
        out.append(rank_by(pool.join(own, "listing_id"), f"landmark_{key}", F.col("near")))
    return out


def blended_score(rrf_score: Column, bm25: Column) -> Column:
    """The fused score where there is one, else what BM25 gave, else 0."""
    return F.when(rrf_score > 0, rrf_score).when(bm25 < 1e8, -bm25).otherwise(0.0)


def reason(bm25: Column, dense: Column, soft: Column, memory: Column) -> Column:
    """Which channels speak for a listing, in words."""
    said = F.concat_ws(
        "; ",
        F.when(bm25 < 1e8, F.format_string("keyword match %.3f", -bm25)),
        F.when(dense.isNotNull(), F.format_string("semantic %.3f", dense)),
        F.when(soft > 0, F.format_string("%d soft preferences", soft)),
        F.when(memory.isNotNull(), F.format_string("your taste %.3f", memory)),
    )
    return F.when(said == "", "matches all hard filters").otherwise(said)


def feature_similarity(canton_same: Column, category_same: Column, rooms: Column, base_rooms: Column, price: Column, base_price: Column) -> Column:
    """2 for an equal canton, 0.5 for an equal category, and closeness in rooms and relative price if the base has both.

    Unknown rooms count as none; a price that is unknown or not positive is close to nothing.
    """
    known = base_rooms.isNotNull() & base_price.isNotNull() & (base_price != 0)
    near = lambda x: F.lit(1.0) / (1.0 + x)
    scalars = near(F.abs(F.coalesce(rooms, F.lit(0)) - base_rooms)) + F.when(price > 0, near(F.abs(price - base_price) / base_price)).otherwise(0.0)
    return F.coalesce(canton_same.cast("double"), F.lit(0.0)) * 2 + F.coalesce(category_same.cast("double"), F.lit(0.0)) * 0.5 + F.when(known, scalars).otherwise(0.0)
