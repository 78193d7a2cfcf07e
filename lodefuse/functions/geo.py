"""Distances on a sphere and the grid that spatial joins meet on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres of one degree of latitude.
DEGREE_KM = 111.195


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; null where a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / size)


def neighbours(x: Column, reach: int = 1) -> Column:
    """The cells from x - reach to x + reach."""
    return F.sequence(x - reach, x + reach)
