"""Null-fill passes with provenance, on rows (listing_id, field, filled, source, confidence, raw).

A pass is a function from state to state: proposals fill fields that are still pending and
never touch others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefuse.functions.features import MENTIONS, feature
from lodefuse.functions.text import html_text, language, says
from lodefuse.operators.signals import majority, nearest

PENDING, UNKNOWN, DROPPED, ORIGINAL = "UNKNOWN-pending", "UNKNOWN", "DROPPED_bad_data", "original"
STATE = ["listing_id", "field", "filled", "source", "confidence", "raw"]


def seed(df: DataFrame, fields: list[str], key: str = "listing_id") -> DataFrame:
    """One row per listing and field: 'original' with confidence 1 where there is a value, else pending."""
    texts = df.select(F.col(key).alias("listing_id"), *[F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f) for f in fields])
    long = texts.unpivot("listing_id", fields, "field", "filled")
    has = F.col("filled").isNotNull()
    return long.select("listing_id", "field", F.coalesce("filled", F.lit(UNKNOWN)).alias("filled"), F.when(has, ORIGINAL).otherwise(PENDING).alias("source"), F.when(has, 1.0).otherwise(0.0).alias("confidence"), F.col("filled").alias("raw"))


def drop_bad(state: DataFrame, bad: Column, reason: Column) -> DataFrame:
    """Marks values that cannot be: the raw text keeps why and what it was."""
    hit = (F.col("source") == ORIGINAL) & F.coalesce(bad, F.lit(False))
    return state.select(
        "listing_id", "field",
        F.when(hit, UNKNOWN).otherwise(F.col("filled")).alias("filled"),
        F.when(hit, DROPPED).otherwise(F.col("source")).alias("source"),
        F.when(hit, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.concat(reason, F.lit(":original_was="), F.col("filled"))).otherwise(F.col("raw")).alias("raw"),
    )


def overlay(state: DataFrame, proposals: DataFrame, gate: str = PENDING) -> DataFrame:
    """Fills what is at the gate with proposals (listing_id, field, value, by, sure, said), at most one a field."""
    met = state.join(proposals, ["listing_id", "field"], "left")
    take = (F.col("source") == gate) & F.col("value").isNotNull()
    return met.select(
        "listing_id", "field",
        F.when(take, F.col("value")).otherwise(F.col("filled")).alias("filled"),
        F.when(take, F.col("by")).otherwise(F.col("source")).alias("source"),
        F.when(take, F.col("sure")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(take, F.col("said")).otherwise(F.col("raw")).alias("raw"),
    )


def extracted(base: float, value: Column, negated: Column) -> tuple[Column, Column, Column]:
    """(value, confidence, raw) of a text extraction: a negated hit is a low-confidence '0'."""
    sure = F.when(negated, F.least(F.lit(0.5), F.lit(base) * 0.6)).otherwise(base)
    return F.when(negated, "0").otherwise("1"), F.round(sure, 3), F.when(negated, F.concat(F.lit("NEG:"), value)).otherwise(value)


def sentinel_fill(state: DataFrame) -> DataFrame:
    """Ends the passes: what is still pending is unknown."""
    return state.withColumn("source", F.when(F.col("source") == PENDING, UNKNOWN).otherwise(F.col("source")))


def violations(state: DataFrame) -> DataFrame:
    """Counts of what a finished state must not have."""
    return state.agg(
        F.count_if(F.col("filled").isNull()).alias("null_filled"),
        F.count_if(F.col("source") == PENDING).alias("pending"),
        F.count_if(~F.col("confidence").between(0, 1)).alias("bad_confidence"),
        F.count_if((F.col("source") == UNKNOWN) & (F.col("filled") != UNKNOWN)).alias("unknown_with_value"),
    )


def extracted(state: DataFrame, listings: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The state with features that titles and descriptions mention (1) or deny (0), where they are still pending.

    listings: (listing_id, title, description). The language is that of the text, German where it can't be told.
    """
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    own = listings.select("listing_id", html_text(text).alias("text")).where("text IS NOT NULL")
    own = own.withColumn("lang", F.when(language(F.col("text")) == "unk", "de").otherwise(language(F.col("text"))))
    hits = F.array(*[F.struct(F.lit(f"feature_{n}").alias("field"), feature(n, F.col("text"), F.col("lang")).alias("h")) for n in names or MENTIONS])
    found = own.select("listing_id", F.inline(F.filter(hits, lambda x: x["h"].isNotNull())))
    proposals = found.select("listing_id", "field", F.col("h.filled").alias("value"), F.col("h.source").alias("by"), F.col("h.confidence").alias("sure"), F.col("h.raw").alias("said"))
    return overlay(state, proposals)


def stale(docs: DataFrame, stored: DataFrame, key: str = "listing_id") -> DataFrame:
    """Rows whose document hash is new or differs from the stored one."""
    return docs.join(stored.select(key, F.col("doc_hash").alias("old")), key, "left").where("old IS NULL OR old <> doc_hash").drop("old")


def wide(state: DataFrame, fields: list[str]) -> DataFrame:
    """The state as one row a listing, with filled and source columns."""
    return state.groupBy("listing_id").pivot("field", fields).agg(F.first("filled").alias("filled"), F.first("source").alias("source"))


def disagreements(a: DataFrame, b: DataFrame, field: str) -> DataFrame:
    """(listing_id, left, right): where two sources fill a field differently."""
    pick = lambda d, n: d.where((F.col("field") == field) & ~F.col("source").isin(PENDING, UNKNOWN, DROPPED)).select("listing_id", F.col("filled").alias(n))
    return pick(a, "left").join(pick(b, "right"), "listing_id").where(F.lower("left") != F.lower("right"))


def geocoded(points: DataFrame, towns: DataFrame, first_km: float | None = None) -> DataFrame:
    """Proposals for city and canton from the nearest town (target_id, tlat, tlon, city, canton) of each point (id, lat, lon)."""
    near = nearest(points, towns.select("target_id", "tlat", "tlon"), first_km).join(towns.select("target_id", "city", "canton"), "target_id")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(c).alias("sure")) for f, c in (("city", 0.9), ("canton", 0.95))])
    out = near.select(F.col("id").alias("listing_id"), F.inline(fields))
    return out.select("listing_id", "field", "value", F.lit("reverse_geocode").alias("by"), "sure", F.col("value").alias("said"))


def voted(rows: DataFrame, known: DataFrame, key: str, field: str) -> DataFrame:
    """Proposals for a field from the majority of those who share a key: known (key, field), rows (listing_id, key)."""
    votes = majority(known, key, field)
    out = rows.join(votes, key)
    return out.select("listing_id", F.lit(field).alias("field"), F.col(field).cast("string").alias("value"), F.lit("plz_majority_vote").alias("by"), F.col("confidence").cast("double").alias("sure"), F.format_string("plz_vote:%d|%d", "n", "total").alias("said"))


def cached(rows: DataFrame, cache: DataFrame, field: str, digits: int = 4, sure: float = 0.9) -> DataFrame:
    """Proposals from a cache (lat, lng, value) met by rounded coordinates; of a place's entries the least value."""
    at = lambda d: {"a": F.round(F.col("lat") * 10**digits).cast("long"), "b": F.round(F.col("lng") * 10**digits).cast("long")}
    known = cache.withColumns(at(cache)).groupBy("a", "b").agg(F.min("value").alias("value"))
    met = rows.withColumns(at(rows)).join(known, ["a", "b"])
    return met.select("listing_id", F.lit(field).alias("field"), "value", F.lit("address_cache").alias("by"), F.lit(sure).alias("sure"), F.col("value").alias("said"))


def checked(value: Column, snippet: Column, text: Column, model_sure: Column, base: float) -> tuple[Column, Column]:
    """(value, confidence) of a model's answer: kept only if its snippet stands in the text; as sure as the less sure."""
    ok = says(text, snippet)
    return F.when(ok, value), F.when(ok, F.least(F.lit(base), model_sure)).otherwise(0.0)


def with_fields(state: DataFrame, listings: DataFrame, fields: list[str], key: str = "listing_id") -> DataFrame:
    """The state with pending rows for fields it lacks."""
    have = state.select("listing_id", "field").distinct()
    names = F.explode(F.array(*[F.lit(f) for f in fields]))
    new = listings.select(F.col(key).alias("listing_id"), names.alias("field")).join(have, ["listing_id", "field"], "left_anti")
    pending = new.select("listing_id", "field", F.lit(UNKNOWN).alias("filled"), F.lit(PENDING).alias("source"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("raw"))
    return state.unionByName(pending)


def curated(existing: DataFrame, mined: DataFrame, dropped: DataFrame, suffix: str, key: str = "key") -> DataFrame:
    """A gazetteer with mined entries put in: keys there already, entries elsewhere and reviewed ones stay out."""
    inside = mined.where(F.rlike("display_name", F.lit(suffix)))
    fresh = inside.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True).join(dropped.select(key), key, "left_anti")
