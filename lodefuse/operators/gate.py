"""The conjunctive filter gate over listings."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefuse.functions.geo import haversine_km
from lodefuse.functions.text import slug, slug_of, token_sort

NEAR_M = 3000.0
#: What a landmark key is made of.
KEY = re.compile(r"\w+")

# fixed values: feature names and the columns that hold them
FEATURES = {
    name: f"feature_{name}"
    for name in (
        "balcony", "elevator", "parking", "garage", "fireplace", "child_friendly",
        "pets_allowed", "temporary", "new_build", "wheelchair_accessible", "private_laundry", "minergie_certified",
    )
}

# fixed values: categories for which a listing without one is a fair match
UNLABELLED_FITS = frozenset({
    "apartment", "furnished_apartment", "studio", "attic_apartment", "maisonette", "loft",
    "penthouse", "terrace_apartment", "holiday_apartment", "duplex", "room", "shared_room",
})

RANGES = ("price", "rooms", "area", "floor", "year_built")
SORTS = {"price_asc": ("price", True), "price_desc": ("price", False), "rooms_asc": ("rooms", True), "rooms_desc": ("rooms", False)}


@dataclass(frozen=True)
class FilterSpec:
    """What a listing must meet; None and empty lists ask nothing."""

    city: list[str] | None = None
    postal_code: list[int] | None = None
    canton: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_rooms: float | None = None
    max_rooms: float | None = None
    min_area: float | None = None
    max_area: float | None = None
    min_floor: int | None = None
    max_floor: int | None = None
    min_year_built: int | None = None
    max_year_built: int | None = None
    available_from: str | None = None
    object_category: list[str] | None = None
    features: list[str] | None = None
    features_excluded: list[str] | None = None
    min_bathrooms: int | None = None
    max_bathrooms: int | None = None
    bathroom_shared: bool | None = None
    has_cellar: bool | None = None
    kitchen_shared: bool | None = None
    near_landmarks: list[str] | None = None
    latitude: float | None = None
    longitude: float | None = None
    radius_km: float | None = None
    sort_by: str | None = None
    limit: int | None = None
    offset: int | None = None
    soft: dict | None = None

    def merged(self, override: FilterSpec) -> FilterSpec:
        """This spec with what another sets; soft preferences are taken key by key."""
        given = {f.name: getattr(override, f.name) for f in fields(self)}
        if override.soft is not None:
            given["soft"] = {**(self.soft or {}), **{k: v for k, v in override.soft.items() if v is not None}}
        return replace(self, **{k: v for k, v in given.items() if v is not None})


#: Rows of a page whose spec names no limit.
PAGE_ROWS = 20


def _asked(values: list[str] | None) -> list[str]:
    return [v.strip() for v in values or [] if v and v.strip()]


def predicate(spec: FilterSpec) -> Column:
    """All clauses on a listing's own columns."""
    clauses: list[Column] = [F.lit(True)]
    if city := [x for v in _asked(spec.city) if (x := slug_of(v))]:
        clauses.append(F.col("city_slug").isin(city))
    if spec.postal_code:
        clauses.append(F.col("postal_code").isin(spec.postal_code))
    if spec.canton:
        clauses.append(F.col("canton") == spec.canton.strip().upper())
    for name in RANGES:
        low, high = getattr(spec, f"min_{name}"), getattr(spec, f"max_{name}")
        if low is not None:
            clauses.append(F.col(name) >= low)
        if high is not None:
            clauses.append(F.col(name) <= high)
    if spec.available_from:
        clauses.append(F.col("available_from") >= spec.available_from)
    if wanted := _asked(spec.object_category):
        among = F.col("object_category").isin(wanted)
        clauses.append(among | F.col("object_category").isNull() if set(wanted) <= UNLABELLED_FITS else among)
    clauses += [F.col(FEATURES[f]) == 1 for f in _asked(spec.features) if f in FEATURES]
    clauses += [F.col(FEATURES[f]) == 0 for f in _asked(spec.features_excluded) if f in FEATURES]
    count = F.regexp_extract("bathrooms", "^[0-9]+", 0).try_cast("int")  # a text whose first character is a digit
    if spec.min_bathrooms is not None:
        clauses.append(count >= spec.min_bathrooms)
    if spec.max_bathrooms is not None:
        clauses.append(count <= spec.max_bathrooms)
    for name in ("bathroom_shared", "has_cellar", "kitchen_shared"):
        if (flag := getattr(spec, name)) is not None:
            clauses.append(F.col(name) == str(flag).lower())
    return reduce(Column.__and__, clauses)


def gate(listings: DataFrame, spec: FilterSpec, distances: DataFrame | None = None) -> DataFrame:
    """Listings that pass; distances (listing_id, landmark_key, dist_m) are read only if landmarks are asked for."""
    out = listings.where(predicate(spec))
    if keys := [k for k in _asked(spec.near_landmarks) if KEY.fullmatch(k)]:  # other keys name no landmark
        near = distances.where(F.col("landmark_key").isin(keys) & (F.col("dist_m") < NEAR_M)).select("listing_id")
        out = out.join(near, "listing_id", "left_semi")
    if spec.radius_km is not None and spec.latitude is not None and spec.longitude is not None:
        reach = spec.radius_km / 111.0 + 1e-9  # degrees of latitude; the exact distance decides
        distance = haversine_km(F.lit(spec.latitude), F.lit(spec.longitude), F.col("latitude"), F.col("longitude"))
        out = out.where(F.col("latitude").between(spec.latitude - reach, spec.latitude + reach)).withColumn("distance_km", distance).where(F.col("distance_km") <= spec.radius_km)
    return out


def order(spec: FilterSpec) -> list[Column]:
    """The order of a gated page: by distance within a radius, by the sort asked for, then by id; nulls last."""
    if spec.radius_km is not None and spec.latitude is not None and spec.longitude is not None:
        return [F.asc("distance_km"), F.asc("listing_id")]
    if spec.sort_by in SORTS:
        name, up = SORTS[spec.sort_by]
        return [F.asc_nulls_last(name) if up else F.desc_nulls_last(name), F.asc("listing_id")]
    return [F.asc("listing_id")]


def page(gated: DataFrame, spec: FilterSpec) -> DataFrame:
    out = gated.orderBy(*order(spec))
    out = out.offset(spec.offset) if spec.offset else out
    return out.limit(PAGE_ROWS if spec.limit is None else spec.limit)


def map_points(listings: DataFrame, spec: FilterSpec) -> DataFrame:
    """Coordinates of all that pass, without paging."""
    found = gate(listings, spec).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return found.select("listing_id", "latitude", "longitude", "price", F.col("area").cast("int").alias("area"))


# fixed values: bounds of a price that can be, and the box that the country lies in
PRICE_BOUNDS = (200, 50_000)
BOX = {"latitude": (45.8, 47.9), "longitude": (5.9, 10.5)}


def bad_price() -> Column:
    """A price that is given but cannot be: above 0 and too low, or too high."""
    return F.coalesce((F.col("price") > 0) & (F.col("price") < PRICE_BOUNDS[0]) | (F.col("price") > PRICE_BOUNDS[1]), F.lit(False))


def bad_rooms() -> Column:
    return F.coalesce(F.col("rooms") == 0, F.lit(False))


def null_island() -> Column:
    return F.coalesce((F.col("latitude") == 0) & (F.col("longitude") == 0), F.lit(False))


def inside(box: dict[str, tuple[float, float]] = BOX) -> Column:
    """Whether a listing has a place within the box."""
    within = [F.col(c).between(*bounds) for c, bounds in box.items()]
    return F.coalesce(reduce(Column.__and__, within), F.lit(False))


def with_enriched(listings: DataFrame, enriched: DataFrame, fields: tuple[str, ...] = ("canton",)) -> DataFrame:
    """Listings with the enriched values of these fields in place of their own; none is dropped, and unknown ones are null.

    enriched: one row a listing with <field>_filled and <field>_source.
    """
    own = enriched.select("listing_id", *[F.when(~F.col(f"{f}_source").isin(*NOT_FILLED), F.col(f"{f}_filled")).alias(f) for f in fields])
    return listings.drop(*fields).join(own, "listing_id", "left")


# fixed values: sources of a field that holds no value
NOT_FILLED = ("UNKNOWN", "UNKNOWN-pending", "DROPPED_bad_data")


def resolve_landmarks(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(name, key): names as landmark keys, by key, then slugged alias, then the alias's words in any order.

    gazetteer: (key, aliases array<string>). Of several keys the least; names without one are left out.
    """
    alias = gazetteer.select("key", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("key"))).alias("alias"))
    forms = lambda c: F.array(F.struct(F.lit(0).alias("step"), c.alias("form")), F.struct(F.lit(1).alias("step"), slug(c).alias("form")), F.struct(F.lit(2).alias("step"), token_sort(c).alias("form")))
    known = alias.select("key", F.inline(forms(F.col("alias")))).where("form <> ''")
    known = known.where((F.col("step") > 0) | (F.col("form") == F.col("key"))).groupBy("step", "form").agg(F.min("key").alias("key"))
    asked = names.select("name", F.inline(forms(F.trim("name"))))
    return asked.join(known, ["step", "form"]).groupBy("name").agg(F.min_by("key", "step").alias("key"))
