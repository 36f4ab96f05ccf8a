"""Great-circle distance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088  # Fixed value: mean earth radius.


def haversine_rad(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Central angle in radians between points given in decimal degrees."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_rad(lat1, lon1, lat2, lon2) * EARTH_RADIUS_KM
