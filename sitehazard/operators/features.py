"""The feature table: one row per location and weather time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from sitehazard.config import (
    DEFAULT_RULES,
    DEFAULT_SIZING,
    QUAKE_MIN_MAGNITUDE,
    RiskRules,
    Sizing,
)
from sitehazard.functions.geo import wind_alignment
from sitehazard.functions.scoring import with_risk
from sitehazard.operators.cleaning import active_hazards, clean_hazards, clean_weather, valid_coordinates
from sitehazard.operators.series import match_nearest, time_features, trend_features
from sitehazard.operators.skew import Series, bring_together, join_few, measure_series
from sitehazard.operators.spatial import hazard_profile, union_hazards

FEATURES = [
    "location_id", "timestamp",
    "hazard_count_10km", "hazard_count_50km", "hazard_count_100km",
    "nearest_hazard_distance_km", "nearest_hazard_type", "hazard_types",
    "temperature", "humidity", "wind_speed", "wind_direction", "precipitation", "pressure",
    "uv_index", "wind_alignment_score", "aqi", "co", "so2", "max_eq_magnitude",
    "hour", "day_of_week", "weekend",
    "temp_3h_avg", "temp_6h_avg", "temp_1h_change", "temp_3h_change",
    "wind_3h_avg", "wind_1h_change", "precip_3h_sum",
]


def strong_quakes(quakes: DataFrame) -> DataFrame:
    return quakes.where(F.col("magnitude") >= QUAKE_MIN_MAGNITUDE)


def hazards_and_quakes(hazards: DataFrame, quakes: DataFrame) -> DataFrame:
    """What counts as a hazard: cleaned active events, then located quakes of the feed."""
    located = valid_coordinates(strong_quakes(quakes))
    return union_hazards(active_hazards(clean_hazards(hazards)), located)


def weather_series(weather: DataFrame, air: DataFrame, sizing: Sizing = DEFAULT_SIZING) -> Series:
    """How the locations' series are grouped, measured on the raw rows of both feeds."""
    stamps = weather.select("location_id", "forecast_timestamp").unionByName(
        air.select("location_id", F.col("timestamp").alias("forecast_timestamp"))
    )
    return measure_series(stamps, "location_id", "forecast_timestamp", sizing.rows_per_task)


def weather_features(weather: DataFrame, air: DataFrame, series: Series) -> DataFrame:
    """Cleaned weather with its trends and the air quality nearest in time."""
    trended = trend_features(clean_weather(bring_together(weather, series)), series)
    return match_nearest(trended, air, series, "timestamp", ["aqi", "co", "so2"])


def first_hazard(hazards: DataFrame) -> Row | None:
    """The hazard listed first, by feed and ``seq``."""
    return hazards.orderBy("feed", "seq").select("latitude", "longitude").first()


def with_wind_alignment(df: DataFrame, hazard: Row | None = None) -> DataFrame:
    """0 to 100, from a hazard to the location.

    That is each location's nearest one (``hazard_lat``, ``hazard_lon``), unless one hazard is
    given for all.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    if hazard is None:
        from_lat, from_lon = F.col("hazard_lat"), F.col("hazard_lon")
    else:
        from_lat, from_lon = F.lit(hazard["latitude"]), F.lit(hazard["longitude"])
    share = wind_alignment(from_lat, from_lon, lat, lon, F.col("wind_direction"))
    return df.withColumn("wind_alignment_score", F.round(share * 100, 2))


def location_profile(
    locations: DataFrame,
    hazards: DataFrame,
    quakes: DataFrame,
    rules: RiskRules = DEFAULT_RULES,
    sizing: Sizing = DEFAULT_SIZING,
) -> DataFrame:
    """Each location's place and what the raw hazards and quakes mean for it."""
    places = locations.select("location_id", "latitude", "longitude")
    return hazard_profile(places, hazards_and_quakes(hazards, quakes), rules, sizing)


def feature_table(
    locations: DataFrame,
    hazards: DataFrame,
    quakes: DataFrame,
    weather: DataFrame,
    air: DataFrame,
    rules: RiskRules = DEFAULT_RULES,
    sizing: Sizing = DEFAULT_SIZING,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Spatial aggregates are computed once per location, then joined to its hours.

    A stored ``profile`` of the locations takes the place of the hazards and quakes.
    """
    series = weather_series(weather, air, sizing)
    hourly = weather_features(weather, air, series).drop("seq")
    if profile is None:
        profile = location_profile(locations, hazards, quakes, rules, sizing)
    joined = join_few(hourly, profile, ["location_id"], series.hot, "left")
    counts = [c for c in profile.columns if c.startswith("hazard_count_")]
    complete = joined.withColumnRenamed("forecast_timestamp", "timestamp").withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in counts},
            "nearest_hazard_type": F.coalesce("nearest_hazard_type", F.lit("None")),
            "hazard_types": F.coalesce("hazard_types", F.lit("")),
            "max_eq_magnitude": F.coalesce("max_eq_magnitude", F.lit(0.0)),
            "aqi": F.col("aqi").cast("int"),
        }
    )
    return complete.transform(with_wind_alignment).transform(time_features).select(*FEATURES)


def risk_table(*args, rules: RiskRules = DEFAULT_RULES, **kwargs) -> DataFrame:
    """The feature table with score, band, advice and components."""
    return with_risk(feature_table(*args, rules=rules, **kwargs), rules)
