"""Listing sources: raw and enriched CSV, split feeds, JSON caches; and their sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefuse.functions.text import category, html_text, slug, tri_state
from lodefuse.operators.gate import FEATURES

#: Spellings of yes and no in the languages of the feeds.
YES, NO = ["true", "1", "yes", "y", "ja", "oui", "si"], ["false", "0", "no", "n", "nein", "non"]

REQUIRED = ["listing_id", "title", "description", "city", "price", "rooms"]


def clean(c: Column) -> Column:
    """Trimmed text; blank and NULL are null."""
    t = F.trim(c)
    return F.when((t != "") & (F.upper(t) != "NULL"), t)


def number(c: Column) -> Column:
    """A number with ' or , between thousands."""
    return F.regexp_replace(clean(c), "[',’ ]", "").try_cast("double")


def flag(c: Column) -> Column:
    low = F.lower(clean(c))
    return F.when(low.isin(YES), 1).when(low.isin(NO), 0)


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def price(df: DataFrame) -> Column:
    """The first that is positive of gross rent, price, and net rent with its extras; whole francs."""
    above = lambda c: F.when(c > 0, c)
    net, extra = above(number(_column(df, "rent_net"))), number(_column(df, "rent_extra"))
    return F.coalesce(above(number(_column(df, "rent_gross"))), above(number(_column(df, "price"))), net + F.coalesce(extra, F.lit(0.0))).cast("int")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw rows as text; quotes may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def normalized(raw: DataFrame) -> DataFrame:
    """Raw rows as listings: trimmed texts, numbers, dates, flags merged from a column and a JSON list of features."""
    listed = F.from_json(_column(raw, "features_json"), "array<string>")
    features = {}
    for name, column in FEATURES.items():
        has = F.when(listed.isNotNull() & F.array_contains(listed, name), 1)
        features[column] = tri_state(flag(_column(raw, column)), has)
    date = F.coalesce(F.try_to_date(clean(_column(raw, "available_from")), "yyyy-MM-dd"), F.try_to_date(clean(_column(raw, "available_from")), "dd.MM.yyyy"))
    images = F.from_json(_column(raw, "images_json"), "struct<images:array<string>,urls:array<string>>")
    return raw.select(
        F.regexp_replace(clean(F.col("listing_id")), r"\.0$", "").alias("listing_id"),
        clean(_column(raw, "title")).alias("title"),
        html_text(_column(raw, "description")).alias("description"),
        clean(_column(raw, "city")).alias("city"),
        slug(_column(raw, "city")).alias("city_slug"),
        number(_column(raw, "postal_code")).cast("int").alias("postal_code"),
        F.upper(clean(_column(raw, "canton"))).alias("canton"),
        price(raw).alias("price"),
        number(_column(raw, "rooms")).alias("rooms"),
        number(_column(raw, "area")).cast("int").alias("area"),
        F.date_format(date, "yyyy-MM-dd").alias("available_from"),
        number(_column(raw, "latitude")).alias("latitude"),
        number(_column(raw, "longitude")).alias("longitude"),
        category(clean(_column(raw, "object_category"))).alias("object_category"),
        F.coalesce(images["images"], images["urls"], F.array().cast("array<string>")).alias("image_urls"),
        *[c.alias(n) for n, c in features.items()],
    )


def splits(frames: list[DataFrame]) -> DataFrame:
    """Feeds of one kind, whatever columns each lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def drift(df: DataFrame, required: list[str] = REQUIRED) -> dict[str, list[str]]:
    """Columns that are missing, and those nobody asked for."""
    have = set(df.columns)
    return {"missing": [c for c in required if c not in have], "extra": sorted(have - set(required))}


def images(spark: SparkSession, path: str) -> DataFrame:
    """(platform_id, stem, path, length) of image files in folders named platform_id=<id>; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(path)
    return files.select(F.regexp_extract("path", r"platform_id=([^/]+)/", 1).alias("platform_id"), F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("stem"), "path", "length")


def with_first(urls: Column, stem: Column) -> Column:
    """The list with its first URL that holds the stem moved to the front."""
    at = F.array_position(F.transform(urls, lambda u: F.contains(u, stem)), True)
    moved = F.concat(F.array(F.get(urls, (at - 1).cast("int"))), F.filter(urls, lambda u, i: i != at - 1))
    return F.when(at > 0, moved).otherwise(urls)


def upserted(table: DataFrame, rows: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """The table with rows put in by key: those there are replaced, or kept if not replace."""
    if replace:
        return table.join(rows.select(key), key, "left_anti").unionByName(rows)
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def export(df: DataFrame, path: str, score: Column, n: int, key: str = "listing_id") -> None:
    """Writes the n rows of highest score, then by key, as JSON and CSV."""
    top = df.withColumn("export_score", score).orderBy(F.desc("export_score"), key).limit(n).drop("export_score")
    top.write.mode("overwrite").json(f"{path}/json")
    flat = [F.to_json(c).alias(c) if is_nested(t) else F.col(c) for c, t in top.dtypes]
    top.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def is_nested(kind: str) -> bool:
    return kind.startswith(("array", "map", "struct"))


def sample(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to n rows of each group, by a seeded hash: reruns agree."""
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("sample_rn", F.row_number().over(order)).where(F.col("sample_rn") <= n).drop("sample_rn")
