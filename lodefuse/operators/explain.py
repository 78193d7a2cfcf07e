"""Why a listing matches: hard checks, keyword hits and soft facts with levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodefuse.operators.gate import FEATURES, RANGES, FilterSpec


def hard_checks(spec: FilterSpec) -> Column:
    """array<struct<label, passed>> of the clauses that were asked for."""
    out = []
    add = lambda label, ok: out.append(F.struct(F.lit(label).alias("label"), F.coalesce(ok, F.lit(False)).alias("passed")))
    if spec.city:
        add("city", F.col("city_slug").isin(spec.city))
    if spec.canton:
        add("canton", F.col("canton") == spec.canton.upper())
    for name in RANGES:
        low, high = getattr(spec, f"min_{name}"), getattr(spec, f"max_{name}")
        if low is not None or high is not None:
            ok = F.col(name).isNotNull()
            ok = ok & (F.col(name) >= low) if low is not None else ok
            ok = ok & (F.col(name) <= high) if high is not None else ok
            add(name, ok)
    if spec.object_category:
        add("object_category", F.col("object_category").isin(spec.object_category))
    for f in spec.features or []:
        if f in FEATURES:
            add(f, F.col(FEATURES[f]) == 1)
    return F.array(*out) if out else F.array().cast("array<struct<label:string,passed:boolean>>")


def keyword_hits(keywords: list[str], columns: list[str]) -> tuple[Column, Column]:
    """(hit, missed) keywords: plain substrings, case aside, of any column."""
    text = F.lower(F.concat_ws(" ", *columns))
    words = F.array(*[F.lit(k) for k in keywords])
    return F.filter(words, lambda k: F.contains(text, F.lower(k))), F.filter(words, lambda k: ~F.contains(text, F.lower(k)))


def level(value: Column, good: float, ok: float, low_is_good: bool = False) -> Column:
    """good, ok or poor by two thresholds; unknown for null."""
    if low_is_good:
        return F.when(value.isNull(), "unknown").when(value <= good, "good").when(value <= ok, "ok").otherwise("poor")
    return F.when(value.isNull(), "unknown").when(value >= good, "good").when(value >= ok, "ok").otherwise("poor")


# fixed values: (good, ok) thresholds and whether low is good
LEVELS = {"quiet": (1000, 300, False), "stop_m": (300, 600, True), "commute": (20, 45, True), "schools": (3, 1, False), "supermarkets": (2, 1, False), "parks": (2, 1, False), "family": (4, 1, False), "landmark_min": (15, 30, True), "landmark_m": (1500, 5000, True)}


def price_level(delta: Column, wanted: str) -> Column:
    """A ratio 0.1 beyond the baseline on the wanted side is good, on the other poor."""
    good, poor = (delta <= -0.1, delta >= 0.1) if wanted == "cheap" else (delta >= 0.1, delta <= -0.1)
    return F.when(delta.isNull(), "unknown").when(good, "good").when(poor, "poor").otherwise("ok")


def metres(c: Column) -> Column:
    """A distance in words: metres, or kilometres from 1000 on."""
    return F.when(c.isNull(), "unknown").when(c < 1000, F.concat(F.round(c).cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_number(c / 1000, 1), F.lit(" km")))


def francs(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.translate(F.format_number(c, 0), ",", "'"), F.lit(" CHF")))


def price_words(delta: Column) -> Column:
    p = F.round(F.abs(delta) * 100).cast("int").cast("string")
    return F.when(delta.isNull(), "no baseline").when(delta < 0, F.concat(p, F.lit("% below typical"))).otherwise(F.concat(p, F.lit("% above typical")))
