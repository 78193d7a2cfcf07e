"""Image search over stored vectors: best images, batch queries, id spaces, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodefuse.functions.vectors import dot


#: Query vectors that are sent to the images at once.
BLOCK = 1000


def against(rows: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Every row with every query of a stated set, which is sent to the rows in blocks of about BLOCK."""
    n = queries.count()
    blocks = -(-n // BLOCK) or 1
    if blocks == 1:
        return rows.crossJoin(F.broadcast(queries))
    part = lambda i: queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)
    return reduce(DataFrame.unionByName, [rows.crossJoin(F.broadcast(part(i))) for i in range(blocks)])


def image_id(c: Column) -> tuple[Column, Column, Column]:
    """(source, platform_id, stem) of an id source/platform/stem.ext."""
    part = lambda i: F.nullif(F.split_part(c, F.lit("/"), F.lit(i)), F.lit(""))
    return part(1), part(2), F.regexp_replace(part(3), r"\.\w+$", "")


def best_image(images: DataFrame, query: DataFrame) -> DataFrame:
    """(listing_id, image_id): each listing's closest image to the one query vector; of equals the least id."""
    q = F.broadcast(query.select(F.col("embedding").alias("q")).limit(1))
    scored = images.crossJoin(q).select("listing_id", "image_id", dot(F.col("embedding"), F.col("q")).alias("s"))
    return scored.groupBy("listing_id").agg(F.min_by("image_id", F.struct(-F.col("s"), F.col("image_id"))).alias("image_id"))


def batch_search(images: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, listing_id, score, image_id, place): the k best listings of each query, by their best image.

    queries (query_id, embedding) go to the images in blocks of at most BLOCK.
    """
    own = queries.select("query_id", F.col("embedding").alias("q"))
    scored = against(images, own, "query_id").select("query_id", "listing_id", "image_id", dot(F.col("embedding"), F.col("q")).alias("s"))
    best = scored.groupBy("query_id", "listing_id").agg(F.max("s").alias("score"), F.min_by("image_id", F.struct(-F.col("s"), F.col("image_id"))).alias("image_id"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "listing_id")
    return best.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def hydrated(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Results keyed by platform_id as listings: (platform_id, listing_id) pairs decide, what none names goes."""
    return found.join(ids.select("platform_id", "listing_id"), "platform_id").drop("platform_id")


def orphans(images: DataFrame, metadata: DataFrame, key: str = "image_id") -> DataFrame:
    """Vectors without metadata; a store must have none."""
    return images.join(metadata.select(key), key, "left_anti").select(key)


#: Coordinates of the grid on which an image meets those that can come nearer to it than itself, and slack for rounding.
AXES, SLACK = 3, 1e-10


def self_match(images: DataFrame, sample: DataFrame) -> DataFrame:
    """(image_id, ok): whether each sampled image is its own nearest.

    A rival e of q has e.q >= q.q, so |e - q|^2 <= |e|^2 - |q|^2: no coordinate differs by more
    than the root of the largest such difference. They meet on a grid of cells of that width;
    equal vectors are one rival, the least id. Without a vector the least id of all is nearest.
    """
    size = lambda c: dot(F.col(c), F.col(c))
    ends = images.agg(F.max(size("embedding")).alias("most"), F.min("image_id").alias("least")).first()
    low = sample.agg(F.min(size("embedding"))).first()[0]
    most = ends["most"] or 0.0
    width = (max(0.0, most - (low or 0.0)) + SLACK * (1 + most)) ** 0.5
    grid = lambda c, i: F.floor(F.coalesce(F.get(F.col(c), F.lit(i)).cast("double"), F.lit(0.0)) / width)
    rivals = images.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("image_id").alias("rival"))
    rivals = rivals.select("embedding", "rival", *[grid("embedding", i).alias(f"g{i}") for i in range(AXES)])
    asked = sample.where("embedding IS NOT NULL").select(F.col("image_id").alias("query_id"), F.col("embedding").alias("q"), size("embedding").alias("own"))
    for i in range(AXES):
        asked = asked.withColumn(f"g{i}", F.explode(F.sequence(grid("q", i) - 1, grid("q", i) + 1)))
    met = asked.join(rivals, [f"g{i}" for i in range(AXES)]).select("query_id", "own", "rival", dot(F.col("embedding"), F.col("q")).alias("s"))
    beaten = met.where("s > own OR (s = own AND rival < query_id)").select(F.col("query_id").alias("image_id"), F.lit(True).alias("beaten")).distinct()
    alone = F.col("embedding").isNotNull() | (F.col("image_id") == F.lit(ends["least"]))
    return sample.join(beaten, "image_id", "left").select("image_id", (F.col("beaten").isNull() & alone).alias("ok"))


def store_report(images: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(index_kind, label, n, allowed): counts of labels by kind, and whether the kind may hold them."""
    pairs = [f"{k}\x1f{x}" for k, own in allowed.items() for x in own]
    out = images.groupBy("index_kind", "label").agg(F.count("*").alias("n"))
    return out.withColumn("allowed", F.concat_ws("\x1f", "index_kind", F.col("label").cast("string")).isin(pairs))


def crosscheck(hits: DataFrame, listings: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Hits joined to their listings with a flag for each check; a missing listing fails none and is marked."""
    met = hits.join(listings.withColumn("known", F.lit(True)), "listing_id", "left")
    return met.select(*hits.columns, F.coalesce("known", F.lit(False)).alias("known"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
