"""Clear-sky UV index from position and UTC time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def solar_elevation(lat: Column, lon: Column, ts: Column) -> Column:
    """Degrees of the sun above the horizon; minutes count, seconds do not."""
    season = F.radians(F.dayofyear(ts) + 284) * 360 / 365
    declination = F.radians(23.44 * F.sin(season))
    solar_hour = F.hour(ts) + F.minute(ts) / 60 + lon / 15
    hour_angle = F.radians(15 * (solar_hour - 12))
    phi = F.radians(lat)
    height = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour_angle)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), height))))


def uv_index(lat: Column, lon: Column, ts: Column) -> Column:
    elevation = solar_elevation(lat, lon, ts)
    distance_from_equator = F.abs(lat)
    peak = (
        F.when(distance_from_equator < 15, 12.0)
        .when(distance_from_equator < 30, 10.0)
        .when(distance_from_equator < 45, 7.0)
        .otherwise(4.0)
    )
    index = F.round(peak * F.pow(F.sin(F.radians(elevation)), F.lit(1.3)), 1)
    return F.when(elevation <= 0, 0.0).otherwise(index)
