"""Great-circle geometry as Column expressions (degrees in, kilometres out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0  # fixed value


def haversine_km(lat1: object, lon1: object, lat2: object, lon2: object) -> Column:
    """Distance between two points; arguments are column names, SQL text or numbers.

    Null if a coordinate is null or NaN. One parsed expression instead of two dozen composed columns: plans hold many of these.
    """
    half_lat = f"((radians({lat2}) - radians({lat1})) / 2)"
    half_lon = f"((radians({lon2}) - radians({lon1})) / 2)"
    chord = (
        f"sin({half_lat}) * sin({half_lat}) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * sin({half_lon}) * sin({half_lon})"
    )
    # Rounding can push the root of an antipodal chord just past 1. Neither a null nor a NaN chord
    # is below 2; ``least`` would read both as 1.
    return F.expr(f"IF({chord} < 2D, {2 * EARTH_RADIUS_KM}D * asin(least(1D, sqrt({chord}))), NULL)")


def wind_alignment(
    hazard_lat: Column, hazard_lon: Column, lat: Column, lon: Column, wind_deg: Column
) -> Column:
    """1 when the wind comes straight from the hazard, 0 when it blows the other way.

    The hazard's direction is the mathematical angle of (Δlat, Δlon), not a compass bearing.
    No direction, or no hazard, gives 0.
    """
    angle = F.pmod(F.degrees(F.atan2(hazard_lat - lat, hazard_lon - lon)), F.lit(360.0))
    apart = F.abs(angle - F.pmod(wind_deg, F.lit(360.0)))
    apart = F.least(apart, 360.0 - apart)
    score = F.greatest(F.lit(0.0), 1.0 - apart / 180.0)
    return F.when(wind_deg.isNull() | F.isnan(wind_deg) | hazard_lat.isNull(), 0.0).otherwise(score)
