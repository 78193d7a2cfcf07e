"""Search plans: gate, channels, fusion, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodefuse.functions.vectors import dot, unit
from lodefuse.operators import bm25 as lexical
from lodefuse.operators.explain import hard_checks
from lodefuse.operators.gate import order
from lodefuse.operators.memory import centroid
from lodefuse.operators.ranking import K, blended_score, feature_similarity, rank_by, rrf
from lodefuse.sources.shared import stored

POOL = 300


def pool(gated: DataFrame, scores: DataFrame | None, limit: int, key: str = "listing_id", least: int = POOL) -> DataFrame:
    """The candidates: the first max(limit, least) by BM25 and id, with their place. Cut before fusion."""
    own = gated.join(scores.select(F.col(key), F.col("score").alias("bm25")), key, "left").fillna({"bm25": lexical.NO_MATCH}) if scores is not None else gated.withColumn("bm25", F.lit(lexical.NO_MATCH))
    top = own.orderBy("bm25", key).limit(max(limit, least))
    return top.withColumn("pool_pos", F.row_number().over(Window.orderBy("bm25", key)))


def dense(pool_: DataFrame, vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(listing_id, dense): dot product with the query's one vector; rows without a vector are left out."""
    q = F.broadcast(query.select(F.col("embedding").alias("q")).limit(1))
    return vectors.join(pool_.select("listing_id"), "listing_id").crossJoin(q).select("listing_id", dot(F.col("embedding"), F.col("q")).alias("dense"))


def best_per_listing(images: DataFrame, query: DataFrame) -> DataFrame:
    """(listing_id, score, image_id): the listing's image closest to the query; of equals the least id."""
    q = F.broadcast(query.select(F.col("embedding").alias("q")).limit(1))
    scored = images.crossJoin(q).select("listing_id", "image_id", dot(F.col("embedding"), F.col("q")).alias("s"))
    return scored.groupBy("listing_id").agg(F.max(F.struct("s", (-F.col("image_id")).alias("i"))).alias("m")).select("listing_id", F.col("m.s").alias("score"), (-F.col("m.i")).alias("image_id"))


def hybrid(gated: DataFrame, corpus: DataFrame, columns: list[str], keywords: list[str], vectors: DataFrame | None = None, query: DataFrame | None = None, soft=None, memory: list[DataFrame] | None = None, dismissed: DataFrame | None = None, limit: int = 20, offset: int = 0, index: lexical.Index | None = None) -> DataFrame:
    """The hybrid search: BM25 over the whole corpus, by its index if there is one, cut to a pool, then the channels' rankings fused.

    soft: a function from the pool to rankings. Text channels are skipped without keywords.
    """
    scores = None
    if keywords:
        scores = index.score(keywords) if index else lexical.score(corpus, "listing_id", columns, keywords)
    candidates = stored(pool(gated, scores, limit + offset), "pool")  # every channel reads it
    rankings = list(soft(candidates) if soft else []) + list(memory or [])
    if keywords:
        rankings.append(candidates.select(F.lit("bm25").alias("ranking"), "listing_id", F.col("pool_pos").alias("rank")))
    if vectors is not None and query is not None:
        scored = candidates.join(dense(candidates, vectors, query), "listing_id", "left")
        rankings.append(rank_by(scored, "dense", F.col("dense"), True))
    if not rankings:
        fused = candidates.withColumn("rrf", F.lit(0.0))
    else:
        fused = candidates.join(rrf(rankings, K), "listing_id", "left").fillna({"rrf": 0.0})
    if dismissed is not None:
        fused = fused.join(dismissed.select("listing_id"), "listing_id", "left_anti")
    page = fused.orderBy(F.desc(F.round("rrf", 12)), "pool_pos")
    return (page.offset(offset) if offset else page).limit(limit)


def lookalikes(listing_id, listings: DataFrame, images: DataFrame, texts: DataFrame, k: int = 10, top: int = 500) -> DataFrame:
    """(listing_id, rrf): the k listings most like one, fused from up to three rankings of all others.

    Images (listing_id, image_id, embedding) rank by the best cosine to the mean of the
    listing's own, texts (listing_id, embedding) by cosine to its text, and listings by
    feature similarity; of the last two the best `top` count. What the listing has no vector for is left out.
    """
    other = F.col("listing_id") != listing_id
    best = lambda scored: scored.orderBy(F.desc("score"), "listing_id").limit(top)
    mean = centroid(images.where(~other).withColumn("one", F.lit(1)), ["one"]).select(unit(F.col("vector")).alias("embedding")).where("embedding IS NOT NULL")
    by_image = best_per_listing(images.where(other), mean).select("listing_id", "score")
    own_text = F.broadcast(texts.where(~other).select(F.col("embedding").alias("q")).limit(1))  # one row
    by_text = best(texts.where(other).crossJoin(own_text).select("listing_id", dot(F.col("embedding"), F.col("q")).alias("score")))
    names = ("canton", "object_category", "rooms", "price")
    base = F.broadcast(listings.where(~other).select(*[F.col(c).alias(f"base_{c}") for c in names]).limit(1))  # one row
    same = [F.col(c) == F.col(f"base_{c}") for c in names[:2]]
    like = feature_similarity(*same, F.col("rooms"), F.col("base_rooms"), F.col("price"), F.col("base_price"))
    by_feature = best(listings.where(other).crossJoin(base).select("listing_id", like.alias("score")))
    ranked = [rank_by(x.withColumn("pool_pos", F.col("listing_id")), n, F.col("score"), True) for n, x in (("image", by_image), ("text", by_text), ("feature", by_feature))]
    return rrf(ranked).orderBy(F.desc(F.round("rrf", 12)), "listing_id").limit(k)


def feed_pool(listings: DataFrame, limit: int) -> DataFrame:
    """The candidates of a feed without a query: twenty pages of them, 300 at least, by id."""
    return pool(listings, None, max(20 * limit, POOL))


def structured(gated: DataFrame, spec, scores: DataFrame | None = None) -> DataFrame:
    """A search without query text: the gated page, scored by BM25 if there are keywords, else 0."""
    own = gated.join(scores.select("listing_id", F.col("score").alias("bm25")), "listing_id", "left").fillna({"bm25": lexical.NO_MATCH}) if scores is not None else gated.withColumn("bm25", F.lit(lexical.NO_MATCH))
    keys = [F.asc("bm25"), F.asc("listing_id")] if scores is not None else order(spec)
    out = own.orderBy(*keys)
    out = (out.offset(spec.offset) if spec.offset else out).limit(spec.limit if spec.limit is not None else 2**31 - 1)
    return out.withColumn("result_score", blended_score(F.lit(0.0), F.col("bm25")))


def explained(page: DataFrame, spec, signals: DataFrame | None = None, facts: dict[str, Column] | None = None) -> DataFrame:
    """Attaches hard checks, and soft facts made of signal columns, to a page only: what is ranked isn't explained."""
    met = page.join(signals, "listing_id", "left") if signals is not None else page
    soft = F.array(*[F.struct(F.lit(k).alias("axis"), c.alias("level")) for k, c in (facts or {}).items()]) if facts else F.array().cast("array<struct<axis:string,level:string>>")
    return met.withColumn("checks", hard_checks(spec)).withColumn("facts", soft)


def snapshot(channels: dict[str, int], pool_size: int, k: int = K) -> dict:
    """Which channels took part, with the items each ranked."""
    return {"channels": sorted(n for n, c in channels.items() if c), "counts": dict(channels), "pool": pool_size, "rrf_k": k}


def activated(soft: dict) -> list[str]:
    """Names of the soft preferences that are on, in a fixed order; a moderate price is none."""
    names = []
    for key in ("price", "quiet", "near_transit", "commute_target", "schools", "supermarkets", "parks", "family"):
        value = soft.get(key)
        if value and not (key == "price" and value == "moderate"):
            names.append(key)
    return names + [f"near_landmark:{x}" for x in soft.get("near_landmark") or []]
