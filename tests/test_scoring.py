import math

import pytest
from pyspark.sql import functions as F

from sitehazard.config import DEFAULT_RULES, SHORT_KEY_RULES, RiskRules
from sitehazard.functions import scoring

ROW = """hazard_types string, nearest_hazard_distance_km double, hazard_count_100km int,
    temp_1h_change double, wind_speed double, humidity double, precipitation double, aqi int,
    co double, so2 double, max_eq_magnitude double"""
CALM = ["", None, 0, 0.0, 10.0, 50.0, 0.0, None, None, None, 0.0]


def one(spark, expression, schema="x double", values=(None,)):
    return spark.createDataFrame([tuple(values)], schema).select(expression.alias("v")).first()["v"]


def each(spark, function, values, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["v"] for r in rows.select("i", function(F.col("x")).alias("v")).orderBy("i").collect()]


def score(spark, rules=DEFAULT_RULES, **changes):
    names = [part.split()[0] for part in ROW.split(",")]
    values = dict(zip(names, CALM)) | changes
    df = spark.createDataFrame([tuple(values[n] for n in names)], ROW)
    return scoring.with_risk(df, rules).first()


def test_hazard_type(spark):
    types = ["Wildfires", "Wildfires,Floods", "", None, "Unlisted", " Floods , Droughts", ","]
    assert each(spark, scoring.hazard_type, types, "string") == [30, 30, 0, 0, 15, 28, 15]


def test_short_keys_fall_back_to_the_default_weight(spark):
    got = each(spark, lambda c: scoring.hazard_type(c, SHORT_KEY_RULES), ["Wildfires", "floods"], "string")
    assert got == [15, 28]


def test_proximity(spark):
    distances = [5.0, 10.0, 10.01, 30.0, 100.0, 100.01, None, math.nan]
    assert each(spark, scoring.proximity, distances) == [25, 25, 15, 15, 5, 0, 0, 0]


def test_several_hazards(spark):
    assert each(spark, scoring.several_hazards, [0, 1, 2, 3, 5, None], "int") == [0, 0, 5, 10, 15, 0]


def test_weather(spark):
    got = one(spark, scoring.weather(F.lit(70.0), F.lit(90.0), F.lit(20.0)))
    assert got == 35.0
    assert one(spark, scoring.weather(F.lit(math.nan), F.lit(None), F.lit(math.nan))) == 0.0
    assert one(spark, scoring.weather(F.lit(30.0), F.lit(69.9), F.lit(10.0))) == 20.0


def test_trend(spark):
    assert each(spark, scoring.trend, [5.0, 4.99, -5.0, -4.99, None, math.nan]) == [10, 0, -5, 0, 0, 0]


def test_air_quality(spark):
    index = lambda c: scoring.air_quality(c, F.lit(None), F.lit(None))
    assert each(spark, index, [None, 0.0, math.nan, 2.0, 3.0, 4.0, 5.0]) == [0, 0, 0, 0, 15, 25, 25]
    assert one(spark, scoring.air_quality(F.lit(4), F.lit(10.0), F.lit(20.0))) == 25.0
    assert one(spark, scoring.air_quality(F.lit(4), F.lit(10.1), F.lit(20.1))) == 35.0


def test_air_quality_without_settings_is_left_out(spark):
    rules = RiskRules(poor_air_index=None, fair_air_index=None, co_limit=None, so2_limit=None)
    assert one(spark, scoring.air_quality(F.lit(5), F.lit(99.0), F.lit(99.0), rules)) == 0.0


def test_earthquake(spark):
    magnitudes = [None, 0.0, 3.9, 4.0, 5.0, 6.0, 7.5, math.nan]
    assert each(spark, scoring.earthquake, magnitudes) == [0, 0, 0, 5, 10, 15, 15, 0]


def test_bands(spark):
    scores = [0.0, 39.0, 39.5, 40.0, 69.0, 69.5, 70.0, 100.0]
    assert each(spark, scoring.band_label, scores) == [
        "Safe", "Safe", "Unknown", "Caution", "Caution", "Unknown", "Avoid", "Avoid",
    ]
    assert each(spark, scoring.band_advice, [20.0, 50.0, 85.0, 39.5]) == [
        "Go now", "Safe with caution", "Avoid today", "Check conditions",
    ]


def test_scenarios(spark):
    assert score(spark)["risk_score"] <= 39
    wildfire = score(
        spark, hazard_types="Wildfires", nearest_hazard_distance_km=8.0, hazard_count_100km=2,
        temp_1h_change=3.0, wind_speed=35.0,
    )
    assert wildfire["risk_score"] == 70 and wildfire["risk_band"] == "Avoid"
    flood = score(spark, hazard_types="Floods", nearest_hazard_distance_km=60.0, hazard_count_100km=1)
    assert flood["risk_score"] == 33
    assert score(spark, aqi=4)["risk_score"] == 25


def test_score_is_clamped_and_components_add_up(spark):
    worst = score(
        spark, hazard_types="Wildfires", nearest_hazard_distance_km=1.0, hazard_count_100km=9,
        temp_1h_change=9.0, wind_speed=90.0, humidity=90.0, precipitation=50.0, aqi=5, co=99.0,
        so2=99.0, max_eq_magnitude=7.0,
    )
    assert worst["risk_score"] == 100
    cool = score(spark, temp_1h_change=-9.0)
    assert cool["risk_score"] == 0 and cool["component_trend"] == -5
    mixed = score(spark, hazard_types="Floods", hazard_count_100km=3, max_eq_magnitude=5.5)
    parts = [v for k, v in mixed.asDict().items() if k.startswith("component_")]
    assert sum(parts) == mixed["risk_score"] == 48


def test_missing_columns_read_as_missing_values(spark):
    df = spark.createDataFrame([("Wildfires",)], "hazard_types string")
    assert scoring.with_risk(df).first()["risk_score"] == 30


@pytest.mark.parametrize("value, expected", [(0.0, True), (50.0, True), (100.0, True), (-1.0, False), (101.0, False)])
def test_valid_score(spark, value, expected):
    assert one(spark, scoring.is_valid_score(F.lit(value))) is expected
