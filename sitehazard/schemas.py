"""Canonical table schemas with column defaults, and alignment to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from sitehazard.config import WEATHER_PROVIDER


def _struct(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


# Column names, types and defaults of the stored tables.

TABLES: dict[str, str] = {
    "raw_hazards": """
        event_id string, category string, title string, status string,
        event_timestamp timestamp, latitude double, longitude double""",
    "raw_weather": """
        forecast_timestamp timestamp, temperature double, humidity double, wind_speed double,
        wind_gust double, wind_direction double, precipitation double, pressure double,
        uv_index double, condition_text string, location_id long, source_name string,
        ingestion_ts timestamp""",
    "raw_air_quality": """
        timestamp timestamp, aqi int, aqi_label string, co double, no double, no2 double,
        o3 double, so2 double, pm2_5 double, pm10 double, nh3 double, location_id long,
        source_name string, ingestion_ts timestamp""",
    "raw_earthquakes": """
        id string, title string, magnitude double, depth_km double, latitude double,
        longitude double, timestamp timestamp, status string, category string,
        location_id long, ingestion_ts timestamp""",
    "raw_explanations": """
        location_id long, timestamp timestamp, recommendation string, risk_band string,
        risk_score double, summary string, top_reasons array<string>, confidence double,
        provider string, ingestion_ts timestamp""",
    "dim_location": """
        location_id long, location_name string, latitude double, longitude double,
        city string, region string, country string""",
    "fact_environment_risk": """
        location_id long, timestamp timestamp, hazard_count_10km int, hazard_count_50km int,
        hazard_count_100km int, nearest_hazard_distance_km double, nearest_hazard_type string,
        hazard_types string, hazard_severity_score double, wind_alignment_score double,
        trend_score double, temperature double, humidity double, wind_speed double,
        wind_direction double, precipitation double, pressure double, uv_index double,
        aqi int, co double, so2 double, max_eq_magnitude double, hour int, day_of_week int,
        weekend int, temp_3h_avg double, temp_6h_avg double, temp_1h_change double,
        temp_3h_change double, wind_3h_avg double, wind_1h_change double,
        precip_3h_sum double, risk_score double, risk_band string, recommendation string,
        component_hazard double, component_proximity double, component_weather double,
        component_trend double, component_multi_hazard double, component_air_quality double, component_earthquake double,
        predicted_risk_6h double, predicted_risk_12h double, confidence_score double,
        explanation_text string""",
}

DEFAULTS: dict[str, dict[str, object]] = {
    "raw_weather": {"location_id": 1, "source_name": WEATHER_PROVIDER, "ingestion_ts": "now"},
    "raw_air_quality": {"location_id": 1, "source_name": WEATHER_PROVIDER, "ingestion_ts": "now"},
    "raw_earthquakes": {"location_id": 1, "ingestion_ts": "now"},
    "raw_explanations": {"location_id": 1, "provider": "rule_based", "ingestion_ts": "now"},
    "fact_environment_risk": {
        "location_id": 1,
        "hazard_count_10km": 0,
        "hazard_count_50km": 0,
        "hazard_count_100km": 0,
        "hazard_severity_score": 0.0,
        "wind_alignment_score": 0.0,
        "trend_score": 0.0,
        "max_eq_magnitude": 0.0,
        "component_hazard": 0.0,
        "component_proximity": 0.0,
        "component_weather": 0.0,
        "component_trend": 0.0,
        "component_multi_hazard": 0.0,
        "component_air_quality": 0.0,
        "component_earthquake": 0.0,
        "confidence_score": 0.8,
    },
}


def table_schema(table: str, timestamps: str = "timestamp") -> T.StructType:
    """Schema of a stored table; ``timestamps`` picks zoned or ``timestamp_ntz`` columns."""
    fields = []
    for field in _struct(TABLES[table]).fields:
        kind = field.dataType
        if isinstance(kind, T.TimestampType) and timestamps == "timestamp_ntz":
            kind = T.TimestampNTZType()
        fields.append(T.StructField(field.name, kind))
    return T.StructType(fields)


def align_to_schema(
    df: DataFrame,
    schema: T.StructType,
    defaults: dict[str, object] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Exactly the schema's columns, in order and type; absent ones are added with a default.

    Columns named in ``keep`` follow as they are.
    """
    defaults = defaults or {}

    def column(field: T.StructField) -> Column:
        if field.name in df.columns:
            value = F.col(f"`{field.name}`")
        elif defaults.get(field.name) == "now":
            value = F.current_timestamp()
        else:
            value = F.lit(defaults.get(field.name))
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields], *keep)


def align_to_table(
    df: DataFrame, table: str, timestamps: str = "timestamp", keep: Sequence[str] = ()
) -> DataFrame:
    return align_to_schema(df, table_schema(table, timestamps), DEFAULTS.get(table), keep)


def add_missing_columns(df: DataFrame, table: str) -> DataFrame:
    """Additive migration: append the table's columns the data lacks, touch nothing else."""
    defaults = DEFAULTS.get(table, {})
    missing = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType)
        for f in table_schema(table).fields
        if f.name not in df.columns and defaults.get(f.name) != "now"
    }
    return df.withColumns(missing) if missing else df
