"""The three curated views, as SQL over registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CURRENT_RISK = """
SELECT d.location_name, d.city, d.region, f.timestamp, f.risk_score, f.risk_band,
       f.recommendation, f.hazard_count_10km, f.hazard_count_50km,
       f.nearest_hazard_distance_km, f.nearest_hazard_type, f.explanation_text
FROM {fact} f
JOIN {locations} d ON f.location_id = d.location_id
WHERE f.timestamp = (SELECT max(timestamp) FROM {fact})
"""

ACTIVE_HAZARDS = """
SELECT event_id, category, title, latitude, longitude, event_timestamp
FROM {hazards}
WHERE status = 'open'
"""

RISK_TREND = """
SELECT location_id, timestamp, risk_score, risk_band, predicted_risk_6h, predicted_risk_12h
FROM {fact}
ORDER BY timestamp
"""


def current_risk(spark: SparkSession, fact: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows of the newest hour in the whole table."""
    return spark.sql(CURRENT_RISK, fact=fact, locations=locations)


def active_hazards(spark: SparkSession, hazards: DataFrame) -> DataFrame:
    return spark.sql(ACTIVE_HAZARDS, hazards=hazards)


def risk_trend(spark: SparkSession, fact: DataFrame) -> DataFrame:
    return spark.sql(RISK_TREND, fact=fact)


def register(
    spark: SparkSession, fact: DataFrame, locations: DataFrame, hazards: DataFrame
) -> None:
    current_risk(spark, fact, locations).createOrReplaceTempView("v_current_risk")
    active_hazards(spark, hazards).createOrReplaceTempView("v_active_hazards")
    risk_trend(spark, fact).createOrReplaceTempView("v_risk_trend")
