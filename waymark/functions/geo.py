"""Distances, travel estimates and grid snapping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import constants as K
from waymark.functions.stats import lookup, rnd


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_dlon) * F.sin(half_dlon)
    km = F.lit(2 * K.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    return F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(km)


def road_km(straight_km: Column, mode: Column) -> Column:
    return straight_km * lookup(K.DETOUR, mode, 1.35)


def travel_minutes(km: Column, mode: Column) -> Column:
    ride = km / lookup(K.SPEED_KMPH, mode, 24.0) * 60.0 + lookup(K.LEG_OVERHEAD_MIN, mode, 8.0)
    return F.when(km <= 0, F.lit(0.0)).otherwise(ride)


def leg(lat1: Column, lon1: Column, lat2: Column, lon2: Column, mode: Column) -> Column:
    """struct(km, minutes) estimated from coordinates alone."""
    km = road_km(haversine_km(lat1, lon1, lat2, lon2), mode)
    return F.struct(
        rnd(km, 4).alias("km"), rnd(travel_minutes(km, mode), 2).alias("minutes")
    )


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlon = F.radians(lon2) - F.radians(lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(dlon)
    return rnd(F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)), 1)


def project_x(lat: Column) -> Column:
    return lat * 111.32


def project_y(lon: Column, ref_lat: Column) -> Column:
    return lon * 111.32 * F.cos(F.radians(ref_lat))


def snap(value: Column, grid: float = 0.005) -> Column:
    """Nearest grid line, half to even."""
    return F.round(F.bround(value / grid) * grid, 5)


def in_bounds(lat: Column, lon: Column) -> Column:
    return lat.between(*K.LAT_RANGE) & lon.between(*K.LON_RANGE)
