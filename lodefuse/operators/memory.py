"""What a user's interactions say: weights, taste, price range, and rankings from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodefuse.functions.vectors import dot, norm, unit
from lodefuse.operators.images import against

# fixed values: weights by kind of interaction
WEIGHTS = {"save": 3.0, "unsave": -3.0, "like": 3.0, "unlike": -3.0, "bookmark": 5.0, "unbookmark": -5.0, "click": 1.0, "dismiss": -2.0, "undismiss": 2.0}
DWELL_SECONDS, DWELL_WEIGHT = 5.0, 2.0
HISTORY_DAYS = 180
COLD_START = 3
TASTE = 0.5


def recent(events: DataFrame, as_of: str, days: int = HISTORY_DAYS) -> DataFrame:
    """Events of the history window before as_of."""
    end = F.lit(as_of).cast("timestamp")
    return events.where((F.col("created_at") >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= end))


def weight(kind: Column, value: Column) -> Column:
    out = F.when((kind == "dwell") & (value >= DWELL_SECONDS), DWELL_WEIGHT)
    for k, w in WEIGHTS.items():
        out = out.when(kind == k, w)
    return out.otherwise(0.0)


def weights(events: DataFrame) -> DataFrame:
    """(user_id, listing_id, weight, dismissed): net weights; dismissed if the last of dismiss and undismiss is dismiss."""
    last = F.max(F.when(F.col("kind").isin("dismiss", "undismiss"), F.struct("created_at", "id", "kind")))
    out = events.groupBy("user_id", "listing_id").agg(F.sum(weight(F.col("kind"), F.col("value"))).alias("weight"), last.alias("last"))
    return out.select("user_id", "listing_id", "weight", F.coalesce(F.col("last.kind") == "dismiss", F.lit(False)).alias("dismissed"))


def cold_start(found: DataFrame, least: int = COLD_START) -> DataFrame:
    """(user_id, positives, cold): users with fewer than three items of positive weight are new."""
    return found.groupBy("user_id").agg(F.count_if(F.col("weight") > 0).alias("positives")).withColumn("cold", F.col("positives") < least)


def feature_taste(found: DataFrame, listings: DataFrame, flags: list[str]) -> DataFrame:
    """(user_id, feature, taste): weighted mean of having (1) or lacking (-1) a feature."""
    met = found.where("weight <> 0").join(listings.select("listing_id", *flags), "listing_id")
    long = met.unpivot(["user_id", "weight"], flags, "feature", "flag").where("flag IS NOT NULL")
    signed = F.sum(F.col("weight") * F.when(F.col("flag") == 1, 1.0).otherwise(-1.0))
    return long.groupBy("user_id", "feature").agg((signed / F.sum(F.abs("weight"))).alias("taste"))


def price_stats(found: DataFrame, listings: DataFrame) -> DataFrame:
    """(user_id, mu, sigma): of log prices of liked listings; one gives a deviation of 0.3, else at least 0.05."""
    own = found.where("weight > 0").join(listings.where("price > 0").select("listing_id", "price"), "listing_id")
    out = own.groupBy("user_id").agg(F.avg(F.log("price")).alias("mu"), F.stddev_samp(F.log("price")).alias("sd"), F.count("*").alias("n"))
    return out.select("user_id", "mu", F.when(F.col("n") == 1, 0.3).otherwise(F.greatest(F.col("sd"), F.lit(0.05))).alias("sigma"))


def price_score(price: Column, mu: Column, sigma: Column) -> Column:
    return F.when(price > 0, -F.abs(F.log(price) - mu) / F.greatest(sigma, F.lit(0.05)))


def price_range(stats: DataFrame) -> DataFrame:
    return stats.select("user_id", F.exp(F.col("mu") - F.col("sigma")).alias("low"), F.exp("mu").alias("typical"), F.exp(F.col("mu") + F.col("sigma")).alias("high"))


def centroid(vectors: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """(by..., vector): mean of vectors; dimensions are averaged apart, so no group is gathered."""
    return pooled(vectors, by, column, F.avg(F.col("x").cast("double")))


def pooled(vectors: DataFrame, by: list[str], column: str, how: Column) -> DataFrame:
    """(by..., vector): `how` aggregates the values x of each dimension."""
    means = vectors.select(*by, F.posexplode(column).alias("i", "x")).groupBy(*by, "i").agg(how.alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))


def gem(vectors: DataFrame, by: list[str], column: str = "embedding", p: float = 3.0) -> DataFrame:
    """(by..., vector): generalized mean of values of at least 1e-6, brought to length one."""
    mean = F.pow(F.avg(F.pow(F.greatest(F.col("x").cast("double"), F.lit(1e-6)), p)), F.lit(1.0 / p))
    return pooled(vectors, by, column, mean).withColumn("vector", unit(F.col("vector")))


def visual_taste(pool: DataFrame, images: DataFrame, liked: DataFrame) -> DataFrame:
    """(listing_id, score): cosine of a listing's mean image to the mean of the images of liked listings in the pool.

    images: (listing_id, embedding). Listings without an image are left out; without liked images nothing is scored.
    """
    own = images.join(pool.select("listing_id"), "listing_id", "left_semi")
    taste = centroid(own.join(liked.select("listing_id"), "listing_id", "left_semi").withColumn("one", F.lit(1)), ["one"])
    taste = taste.select(unit(F.col("vector")).alias("q")).where("q IS NOT NULL")
    met = centroid(own, ["listing_id"]).crossJoin(F.broadcast(taste))  # one row
    return met.select("listing_id", dot(unit(F.col("vector")), F.col("q")).alias("score")).where("score IS NOT NULL")


def feature_score(pool: DataFrame, taste: DataFrame, flags: list[str]) -> DataFrame:
    """(listing_id, score): a user's taste (feature, taste) times having (1) or lacking (-1) each feature; no taste scores nothing."""
    signed = F.create_map(*[x for f in flags for x in (F.lit(f), F.when(F.coalesce(F.col(f) == 1, F.lit(False)), 1.0).otherwise(-1.0))])
    own = taste.where(F.col("feature").isin(flags)).agg(F.map_from_entries(F.collect_list(F.struct("feature", "taste"))).alias("t"))  # one row of as many features as there are
    some = F.exists(F.map_values("t"), lambda x: F.abs(x) >= 1e-9)
    total = F.aggregate(F.map_entries("t"), F.lit(0.0), lambda a, e: a + e["value"] * F.try_element_at(signed, e["key"]))
    return pool.crossJoin(F.broadcast(own.where(some))).select("listing_id", total.alias("score"))


def semantic_taste(pool: DataFrame, vectors: DataFrame, liked: DataFrame, disliked: DataFrame) -> DataFrame:
    """(listing_id, score): cosine to the mean of liked minus half the mean of disliked."""
    pos = centroid(vectors.join(liked, "listing_id", "left_semi").withColumn("one", F.lit(1)), ["one"]).select(F.col("vector").alias("p"), "one")
    neg = centroid(vectors.join(disliked, "listing_id", "left_semi").withColumn("one", F.lit(1)), ["one"]).select(F.col("vector").alias("n"), "one")
    query = pos.join(neg, "one", "left").select(F.when(F.col("n").isNull(), F.col("p")).otherwise(F.zip_with("p", "n", lambda a, b: a - 0.5 * b)).alias("q"))
    met = vectors.join(pool.select("listing_id"), "listing_id").crossJoin(F.broadcast(query))  # one row
    return met.where(norm(F.col("q")) > 0).select("listing_id", (dot(F.col("embedding"), F.col("q")) / norm(F.col("q"))).alias("score"))


def demoted(pool: DataFrame, vectors: DataFrame, dismissed: DataFrame, cold: bool, limit: float = 0.85) -> DataFrame:
    """The pool in order, dismissed listings and, unless the user is new, those close to one moved behind."""
    own = pool.join(dismissed.select("listing_id", F.lit(True).alias("gone")), "listing_id", "left")
    if cold:
        sunken = F.coalesce("gone", F.lit(False))
    else:
        near = vectors.join(pool.select("listing_id"), "listing_id", "left_semi").select("listing_id", F.col("embedding"))
        bad = vectors.join(dismissed, "listing_id", "left_semi").select(F.col("embedding").alias("bad"))
        close = against(bad, near, "listing_id").groupBy("listing_id").agg(F.max(dot(F.col("embedding"), F.col("bad"))).alias("top"))
        own = own.join(close, "listing_id", "left")
        sunken = F.coalesce("gone", F.lit(False)) | F.coalesce(F.col("top") > limit, F.lit(False))
    return own.withColumn("sunken", sunken).select("listing_id", "pool_pos", "sunken", F.row_number().over(Window.orderBy("sunken", "pool_pos")).alias("place"))


def composite(*scores: Column) -> Column:
    """Mean of the channels that scored a listing; null if none did."""
    known = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def latest(events: DataFrame, kinds: list[str]) -> DataFrame:
    """(user_id, listing_id, kind): the last of these kinds for each user and listing."""
    by = Window.partitionBy("user_id", "listing_id").orderBy(F.desc("created_at"), F.desc("id"))
    return events.where(F.col("kind").isin(kinds)).withColumn("rn", F.row_number().over(by)).where("rn = 1").select("user_id", "listing_id", "kind")


def tags(taste: DataFrame, least: float = TASTE, most: int = 6) -> DataFrame:
    """(user_id, side, feature, taste): up to six liked and six avoided features."""
    own = taste.where(F.abs("taste") >= least).withColumn("side", F.when(F.col("taste") > 0, "liked").otherwise("avoided"))
    by = Window.partitionBy("user_id", "side").orderBy(F.desc(F.abs("taste")), "feature")
    return own.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most).select("user_id", "side", "feature", F.round("taste", 3).alias("taste"))
