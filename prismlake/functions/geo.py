"""Great-circle arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
FLAT_KM_PER_DEGREE = 111.2


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def wrap_longitude(lon: Column) -> Column:
    """Longitude read modulo 360, into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance with the longitude scaled at the mean latitude; it does not wrap at the date line."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = lat2 - lat1
    return F.sqrt(dx * dx + dy * dy) * FLAT_KM_PER_DEGREE
